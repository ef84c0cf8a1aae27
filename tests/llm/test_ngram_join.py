import random
import re

import numpy as np
import pytest

from faultlens.llm import ngram_join as g

SCHEMA = "doc_id long, text string, n int, token long, hub long, component_id string"


def gram_set(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = {i: gram_set(t, k) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(gram_set(t, k)), None if i is None else find(i)) for i, t, *_ in rows}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in it is").__add__("") if rng.random() < 0.0 else rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.5 else f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(80)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:  # near copies with more and more edits
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        elif kind == 1:  # a common passage in own text
            w = [word() for _ in range(rng.randint(5, 60))] + passage
        elif kind == 2:
            w = [word() for _ in range(rng.randint(1, 40))]
        else:  # copies of an earlier row, edited once
            w = (rows[rng.randrange(len(rows))][1] or "x").split()
            if rng.random() < 0.7:
                w.insert(rng.randrange(len(w) + 1), f"i{i}")
        rows.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in w), 1, 1, 1, "x"))
    return rows


@pytest.mark.parametrize(("k", "num", "seed"), [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_against_brute_force(spark, k, num, seed):
    rows = corpus(seed)
    rows += [(1000, None, 1, 1, 1, "x"), (1001, "", 1, 1, 1, "x"), (1002, " \n", 1, 1, 1, "x"), (1003, "one two", 1, 1, 1, "x"), (1004, "ONE\ttwo ", 1, 1, 1, "x"), (None, "one two", 1, 1, 1, "x"), (0, rows[0][1], 1, 1, 1, "x"), (1005, " ".join(f"v{i}" for i in range(5000)), 1, 1, 1, "x")]
    got = g.jaccard_components(spark.createDataFrame(rows, SCHEMA), words=k, threshold=(num, 100), chunk=7, per_salt=5)
    found = got.collect()
    assert len(found) == len(rows) and {tuple(r) for r in found} == brute(rows, k, num, 100)


def test_empty(spark):
    assert g.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_gives_overlaps_or_proves_too_little():
    rng = np.random.default_rng(1)
    for _ in range(40):
        order = rng.permutation(np.unique(rng.integers(-(2**63), 2**63 - 1, 60)))
        some = lambda n: [order[np.sort(rng.choice(len(order), rng.integers(1, 50), replace=False))] for _ in range(n)]  # noqa: B023, E731
        sets, probes = some(20), some(5)
        trie = g.SetTrie(sets)
        for num in (50, 80, 95):
            least = g.least_overlap(np.array([[len(s)] for s in sets]), np.array([[len(p) for p in probes]]), (num, 100))
            both = trie.overlaps(probes, least)
            for i, s in enumerate(sets):
                for k, p in enumerate(probes):
                    true = len(np.intersect1d(s, p))
                    links = 100 * true >= num * (len(s) + len(p) - true)
                    assert links == (true >= least[i, k]) and both[i, k] == (true if links else -1)


def test_words_without_structural_collisions():
    a, b = b"a", b"b"
    for _ in range(12):  # Thue-Morse words collide under polynomials modulo 2^64
        a, b = a + b, b + a
    for x, y in ((a, b), (a[:2048], b[:2048])):
        assert x != y and g.word_hashes(x)[0] != g.word_hashes(y)[0]
    words = [bytes([97 + i // 676, 97 + i // 26 % 26, 97 + i % 26]) * k for i in range(2000) for k in (1, 2, 15)]
    assert len(set(g.word_hashes(b" ".join(words)).tolist())) == len(set(words))


def test_a_shingle_of_many_components(spark):
    """Groups around one rare passage that no hub joins, and groups that hang together through loose texts only."""
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = [f"p{i}" for i in range(22)] + [f"g{group}_{i}" for i in range(rng.randint(4, 10))]
        for _ in range(14):
            w = list(base)
            w[rng.randrange(22, len(w))] = f"e{rng.randint(0, 3)}"
            rows.append((len(rows), " ".join(w), 1, 1, 1, "x"))
    for chunk, per_salt in ((5, 3), (256, 64)):
        got = g.jaccard_components(spark.createDataFrame(rows, SCHEMA), words=3, threshold=(80, 100), chunk=chunk, per_salt=per_salt)
        assert {tuple(r) for r in got.collect()} == brute(rows, 3, 80, 100)


def test_shingles_match_sets():
    texts = ["", " ", "a", "A b", "a b c d", "a b c d a b c d", "x " * 50, "ÄÖ ä ö ü " * 3]
    for t, s, alone in zip(texts, g.shingle_sets([t.encode() for t in texts], 4), (g.shingles(t.encode(), 4) for t in texts)):
        assert len(s) == len(gram_set(t, 4)) and (s == alone).all()


def test_large_and_small_groups_of_copies_alike(spark, monkeypatch):
    base = [" ".join(f"w{i}{k}" for k in range(40)) for i in range(6)]
    rows = [(i, base[i % 6] if i < 40 else base[0] + " more") for i in range(60)] + [(60, None), (61, " "), (None, base[0]), (0, base[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for large in (1, 10, 200):  # none, some and all of the sets are large
        monkeypatch.setattr(g, "LARGE", large)
        found.append(sorted((tuple(r) for r in g.jaccard_components(docs).collect()), key=str))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_ids_with_several_texts_whatever_the_order(spark):
    """The least text counts, for links and for the number of shingles."""
    base = [f"a{i}" for i in range(40)]
    near = lambda k: " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])
    other = " ".join(f"z{i}" for i in range(40))
    rows = [(1, near(3)), (5, near(5)), (5, other), (7, other + " end"), (9, near(9)), (11, None), (11, near(11)), (12, None), (12, ""), (None, near(3)), (None, other), (5, near(5)), (20, near(4)), (20, near(4).upper())]
    rows += [(30, f"{near(i % 5)} {i}") for i in range(60)]
    least = {}
    for i, t in rows:
        if i is not None and t is not None:
            least[i] = min(t, least.get(i, t))
    single = [(i, t if i is None else least.get(i)) for i, t in rows]
    want = sorted(((i, len(gram_set(t, 4)), c) for i, t, c in ((i, t, dict((x[0], x[2]) for x in brute([(j, u) for j, u in single if j is not None], 4, 85, 100)).get(i)) for i, t in single)), key=str)
    for seed in range(2):
        shuffled = list(rows)
        random.Random(seed).shuffle(shuffled)
        found = g.jaccard_components(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(1 + seed)).collect()
        assert sorted(map(tuple, found), key=str) == want
