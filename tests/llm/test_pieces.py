import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultlens.llm import pieces as p


def vocabulary(extra=()):
    base = [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [("<unk>", 0.0, "control")]
    words = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab", "▁▁", "é", "éa", "c", "abc", "▁ba", *extra]
    return base + [(w, -float(3 + (7 * i) % 11) - 0.25 * len(w), None) for i, w in enumerate(words)]


def brute(model, text):
    """Best total by trying every segmentation, a character at a time."""
    s = " " + text
    keys = {sp.decode(): i for i, sp in reversed(list(enumerate(model.spelling))) if sp and i > 256}
    best = {0: 0.0}
    for i in range(len(s)):
        if i not in best:
            continue
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in keys:
                best[j] = max(best.get(j, -1e18), best[i] + model.scores[keys[s[i:j]]])
        if s[i] not in keys:
            best[i + 1] = max(best.get(i + 1, -1e18), best[i] + model.unknown)
    return best[len(s)]


def total(model, ids):
    out, spelt = 0.0, b""
    for i in ids:
        if i < 256:
            spelt += model.spelling[i]
        else:
            out += model.scores[i]
    return out + model.unknown * len(spelt.decode())


@pytest.mark.parametrize("extra", [(), ("a▁b",)])
def test_best_segmentation(extra):
    model = p.Pieces.of(vocabulary(extra))
    assert model.by_word == (not extra)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aabbc é▁日 ") for _ in range(rng.randint(1, 14)))
        ids = [int(i) for x in model.segment(model.words(text.encode())) for i in x]
        assert model.decode(ids).decode() == text
        assert abs(total(model, ids) - brute(model, text)) < 1e-9


MODEL = p.Pieces.load(p.DEFAULT_MODEL)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_public_vocabulary_round_trip(text):
    raw = text.encode("utf-8", "surrogatepass") if text.isprintable() else text.encode("utf-8", "replace")
    ids = [int(i) for x in MODEL.segment(MODEL.words(raw)) for i in x]
    assert MODEL.decode(ids) == raw


def test_double_array():
    keys = {bytes(random.Random(i).choices(range(256), k=1 + i % 5)): i for i in range(2000)}
    trie = p.DoubleArray.build(keys)
    for k, v in keys.items():
        s = 0
        for c in k:
            n = trie.base[s] + c
            assert trie.check[n] == s
            s = n
        assert trie.value[s] == v
    assert np.all(trie.base >= 0)


def test_table(spark):
    schema = "doc_id long, text string, ids int, decoded string"
    rows = [(1, "ab ab  c", 1, "x"), (1, "ab ab  c", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (None, " ▁ é\n日", 1, "x"), (4, "ba " * 40_000, 1, "x")]
    model = p.Pieces.of(vocabulary())
    out = p.decode(p.encode(spark.createDataFrame(rows, schema), model, cache_bytes=5), model).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.decoded) for r in out) == sorted((i is None, i, t or "") for i, t, *_ in rows)
    assert {r.doc_id: r.n_pieces for r in out}[2] == 0 and {r.doc_id: r.n_byte_pieces for r in out}[None] == 7
    assert p.decode(p.encode(spark.createDataFrame([], schema), model), model).count() == 0


def test_long_words_as_short_ones(monkeypatch):
    rng = random.Random(12)
    pieces = p.Pieces.of([(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [(p.MARKER, -2.0, None)] + [(x, -rng.random() * 9, None) for x in sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(40)})])
    words = ["".join(rng.choice("abécd世😀") for _ in range(rng.randint(1, 90))).encode() for _ in range(60)]
    want = pieces.segment(words)
    for window in (1, 7, 1 << 16):
        monkeypatch.setattr(p, "LONG", 0)
        monkeypatch.setattr(p, "WINDOW", window)
        assert all(a.tolist() == b.tolist() for a, b in zip(want, pieces.segment(words), strict=True))


def test_megabyte_without_a_space():
    pieces = p.Pieces.of([(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [(x, -1.0 - len(x) / 9, None) for x in ("a", "b", "ab", "abba", "b" * 20)])
    rng = random.Random(1)
    word = " ".encode() + "".join(rng.choice("abc") for _ in range(1_000_000)).encode()
    began = time.perf_counter()
    ids = pieces.segment([word])[0]
    assert pieces.decode(ids.tolist()) == word[1:] and time.perf_counter() - began < 60


def test_ranks_become_log_probabilities():
    scores = p.log_probabilities(np.array([0.0, 0.0, -1.0, -2.0, -3.0]), np.array([False, True, True, True, True]))
    assert abs(np.exp(scores[1:]).sum() - 1) < 1e-12 and (np.diff(scores[1:]) < 0).all() and scores[0] == 0
    assert abs(scores[1] - scores[2] - np.log(2)) < 1e-12
    own = np.array([-1.5, -2.25, -0.5])
    assert (p.log_probabilities(own, np.ones(3, bool)) == own).all()
