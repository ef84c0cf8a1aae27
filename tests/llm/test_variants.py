import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from faultlens.llm import queries
from faultlens.llm import variants as v

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs, least=5, occurrences=3):
    n = {}
    for doc_id, text, *_ in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if c >= occurrences}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 2 * n[a] else None
    out = set()
    for a in n:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, n[a], len(near[a]), form[a], n[form[a]] if form[a] else None, root))
    return out


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aabé") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["straße", "aaaaa", "aaaaaa", "aaaaaaa", "résumé", "resume", "abcdefghijkl"]
    words = []
    for s in stems:
        for _ in range(6):
            w = list(s)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                w[i : i + (kind > 0)] = [] if kind == 2 else [rng.choice("aabxéÿ")]
            words.append("".join(w))
    weights = [1 / (1 + rng.randrange(40)) for _ in words]
    docs = [(i, rng.choice([" ", "-", "1", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=60)), "x", 1) for i in range(80)]
    return docs + [(None, docs[0][1], "x", 1), (100, None, "x", 1), (101, "", "x", 1), (102, "À×÷ÀÀ straße STRASSE ĀĀĀĀĀ Ωωωωω", "x", 1), (103, "straße " * 3000 + "q" * 2000, "x", 1), (5, docs[5][1], "x", 1), (5, docs[5][1], "x", 1)]


DDL = "doc_id long, text string, word string, n long"


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 16), (2, 6)])
def test_against_brute_force(spark, seed, block):
    docs = corpus(seed)
    words = v.vocabulary(spark.createDataFrame(docs, DDL))
    n = counted(docs)
    assert {tuple(r) for r in words.collect()} == set(n.items()) and len(n) > 60
    got = v.spelling_variants(words, block=block).collect()
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute(n) and len(got) == len(n)
    assert any(r.form not in (None, r.root) for r in got)


def test_query_against_sql(spark, tmp_path):
    docs = corpus(3)
    spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op13_spelling_variants"])
    names = [c[0] for c in want.description]
    got = queries.op13_spelling_variants(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


def test_no_words(spark):
    for docs in ([], [(1, None, "x", 1), (2, "of it 12", "x", 1)]):
        assert v.spelling_variants(v.vocabulary(spark.createDataFrame(docs, DDL))).count() == 0


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        a, b, c, d = (rng.integers(0, n + 1, 50) for _ in range(4))
        k, found = v.WaveletTree(values).report(a, b, c, d)
        want = [(q, int(x)) for q in range(50) for x in values[a[q] : b[q]] if c[q] <= x < d[q]]
        assert sorted(zip(k.tolist(), found.tolist(), strict=True)) == sorted(want)


def test_counts_are_handed_over_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(v, "HELD", 5)
    docs = corpus(4)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in docs], pa.int64()), pa.array([r[1] for r in docs])], names=["doc_id", "text"])
    parts = list(v._counts(5, 97)(iter([batch])))
    n = {}
    for p in parts:
        for w, c in zip(*(x.to_pylist() for x in p.columns), strict=True):
            n[w] = n.get(w, 0) + c
    assert len(parts) > 1 and {w: c for w, c in n.items() if c >= 3} == counted(docs)
