import random
import re

import duckdb
import numpy as np
import pytest

from faultlens.llm import decontaminate as d
from faultlens.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(span, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    widths = {len(k) for k in windows}
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for m in widths:
            for i in range(len(w) - m + 1):
                of = windows.get(tuple(w[i : i + m]))
                if of:
                    hit.update(range(i, i + m))
                    found |= {str(x) for x in of if x is not None}
        runs = []
        for p in sorted(hit):
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        out.append((doc_id, len(w), len(hit), [tuple(r) for r in runs], sorted(found)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randint(0, 60)}"
    some = lambda n: [word() for _ in range(n)]
    common = some(14)
    items = [(i, " ".join(some(rng.randint(0, 12)) + (common if i % 3 == 0 else some(rng.randint(1, 30))) + some(rng.randint(0, 9)))) for i in range(30)]
    items += [(100, "of w1"), (101, "Only"), (102, None), (103, "..."), (None, " ".join(common)), (5, "one two three four five six seven eight nine"), (104, items[4][1]), (4, items[7][1])]
    docs = []
    for i in range(90):
        w = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):  # parts of items, with and without an edit
            of = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(of) - 1))
            part = of[a : a + rng.randint(1, 25)]
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.2 else x for x in w), 1, 2, "x", "y"))
    docs += [(200, None, 1, 1, "", ""), (201, "", 1, 1, "", ""), (202, " ..\n", 1, 1, "", ""), (None, items[0][1], 1, 1, "", ""), (3, docs[3][1], 1, 1, "", ""), (3, items[6][1], 1, 1, "", "")]
    docs += [(204, "one two three four five six seven eight", 1, 1, "", ""), (205, "ONE two-three four five six seven eight nine ten", 1, 1, "", ""), (206, " ".join(f"v{i}" for i in range(3000)) + " " + items[1][1], 1, 1, "", "")]
    docs += [(300 + i % 2, items[3][1], 1, 1, "", "") for i in range(40)]  # a large group of copies
    return docs, items


def made(spark, docs, items, **kw):
    docs = spark.createDataFrame(docs, "doc_id long, text string, print int, n_words long, key string, cls string")
    return d.contamination(docs, d.Benchmark(spark.createDataFrame(items, "item_id long, text string"), **kw))


@pytest.mark.parametrize(("seed", "span", "gram", "filter_bytes"), [(1, 10, 5, 1 << 20), (2, 10, 5, 8), (3, 6, 3, 1 << 20)])
def test_against_brute_force(spark, seed, span, gram, filter_bytes, monkeypatch):
    monkeypatch.setattr(d, "HOT", 8)
    docs, items = corpus(seed)
    got = made(spark, docs, items, span=span, gram=gram, filter_bytes=filter_bytes).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r["items"])) for r in got), key=str)
    assert found == brute(docs, items, span)
    assert all(r.n_items == len(r["items"]) for r in got) and sum(r.n_hit > 0 for r in got) > 40


def test_query_against_sql(spark, tmp_path):
    docs, items = corpus(5)
    spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op11_decontamination(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op11_decontamination"])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))


def test_empty_tables(spark):
    docs, items = corpus(1)
    assert made(spark, [], items).count() == 0
    none = made(spark, docs, []).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 and r.spans == [] and r["items"] == [] for r in none)


def test_every_shared_span_has_a_common_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(0, 5, 10).astype(np.uint64)
        prints = []
        for _ in range(2):
            w = np.concatenate([rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64)])
            prints.append(set(d.smallest(d._grams(w, 5), 6).tolist()))
        assert prints[0] & prints[1]


def test_words_are_the_same_in_pieces_and_alone():
    long = b"q" * 5000
    texts = [b"a B1 c", b"", b"x" * 70, long + b" a", "Ärger öl ".encode() * 30, b"-" * 50 + b"z"]
    whole, starts = d.words_of(b" ".join(texts))
    alone = [d.words_of(t)[0] for t in texts]
    assert (whole == np.concatenate(alone)).all() and len(starts) == len(whole)
    assert (d.words_of(b" ".join(texts), together=7)[0] == whole).all()
    assert [len(a) for a in alone] == [len(words(t.decode())) for t in texts]
