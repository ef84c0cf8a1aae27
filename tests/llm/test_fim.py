import hashlib
import re

import duckdb
import pytest

from faultlens.llm import fim, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", "a ", " a", " a  b\n", "a b   c", "<P> x", "x <S", "P> <S<M", "a <M> b", "<M> ", "ä 𝄞𝄞 ö\tü\x0b\x1c z", "< P > <S <M\n", "<P\n>", "x " * 4000, "\u0000 \u0000", "w" * 3000, "one\r\ntwo  three ", "<", "<S<", "é e ﻿x"]


def brute(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    hexa = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexa[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    return [(i * 7 + k, t, 1, "x") for i, t in enumerate(TEXTS) for k in range(6)] + [(None, "a b c", 2, "y"), (None, None, 3, None), (1004, "a b", 1, "x"), (1004, "a b", 1, "x")]


def test_against_plain_reading(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string")
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored()).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute(i, t) for i, t, *_ in rows), key=key)
    want = {i: t or "" for i, t, *_ in rows if i is not None}
    assert all(r.back == want[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_outputs_in_several_batches(spark, rows, monkeypatch):
    docs = [(i, t) for i, t, *_ in rows]
    monkeypatch.setattr(fim, "BATCH", 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    out = list(fim._transform(42, 50, 80)(iter([batch])))
    assert len(out) > 10 and sum(b.num_rows for b in out) == len(docs)


def test_rates(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'one two three' as text")
    forms = lambda **kw: {r.form for r in fim.fill_in_middle(docs, **kw).select("form").distinct().collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, suffix_first=0) == {"psm"} and forms(rate=100, suffix_first=100) == {"spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query_against_sql(spark, rows, tmp_path):
    docs = [(r[0], r[1]) for r in rows if r[1] is None or "\u0000" not in r[1]]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op12_fill_in_middle"])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))
