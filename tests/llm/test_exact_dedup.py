import hashlib
import re
from collections import defaultdict

import pytest

from faultlens.llm import exact_dedup as d

SCHEMA = "doc_id long, text string, digest string, key int, size int, best int"


def rows():
    out = [(i, f"text {i % 40}" + " " * (i % 3), "x", 1, 1, 1) for i in range(300)]
    out += [(500, None, "x", 1, 1, 1), (501, "", "x", 1, 1, 1), (502, " \t\n\x0b\x0c\r", "x", 1, 1, 1), (503, " ", "x", 1, 1, 1), (None, "text 1", "x", 1, 1, 1), (7, "text 7 ", "x", 1, 1, 1), (600, "é" * 50_000, "x", 1, 1, 1), (None, None, "x", 1, 1, 1)]
    return out


def brute(data):
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-(len(t or "")), i is None, i))
    out = []
    for body, g in groups.items():
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out += [(i, keep, len(g), hashlib.sha256(body.encode()).hexdigest()) for _, _, i in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [32, 1])
def test_against_brute_force(spark, size):
    data = rows()
    got = d.exact_dedup(spark.createDataFrame(data, SCHEMA).repartition(3), digest_bytes=size, capacity=50).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(data)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark):
    assert d.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_are_sorted(spark):
    index = d.DigestIndex(spark, capacity=10)
    index.flush(spark.createDataFrame(rows(), SCHEMA).coalesce(1))
    by = defaultdict(list)
    for r in index.entries().collect():
        by[r.row.run].append((r.row.task, bytes(r.digest)))
    assert len(by) > 20 and all(len(x) <= 10 and x == sorted(x) for x in by.values())


def test_keep_one_keeps_columns_and_the_longest_text(spark):
    schema = "doc_id long, text string, kept string, `a.b` string"
    rows = [(1, "x y", "p", "q"), (1, "x  y", "r", "s"), (2, "xy", "p", "q"), (3, None, None, None), (None, "", "p", "q"), (None, "z", "p", "q"), (None, "z", "p", "q")]
    out = d.keep_one(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "kept", "a.b"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "x  y", "r", "s"), (3, None, None, None), (None, "z", "p", "q")]))
    assert d.keep_one(spark.createDataFrame([], schema)).count() == 0


def test_index_used_again(spark):
    data = rows()
    index = d.DigestIndex(spark, capacity=20, fanout=2)
    seen = []
    for k in range(5):
        seen += data[k::5]
        index.flush(spark.createDataFrame(data[k::5], SCHEMA).repartition(2))
        if k in (0, 1, 3, 4):
            got = index.compact()
            want = {(i, n, sha) for i, keep, n, sha in brute(seen) if i == keep}
            assert {(~r.best.inv if r.best.inv is not None else None, r.size, bytes(r.key).hex()) for r in got.collect()} >= {x for x in want if x[0] is not None}
            assert got.count() == got.select("key").distinct().count() == len({sha for *_, sha in brute(seen)})
            assert all(level for level, _ in index.parts)
    assert [level for level, _ in index.parts] == [3] and index.flushed == 5
    ids = index.entries().select("row.*")
    assert ids.count() == ids.distinct().count() == len(data)
    again = d.DigestIndex(spark, index.path, fanout=2)
    assert (again.version, again.parts, again.flushed) == (index.version, index.parts, index.flushed)
    assert again.level().count() == got.count()


def test_filter_keeps_all_hits_and_little_else(spark):
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(4000)]
    held = d.HitFilter(spark.createDataFrame([(k,) for k in keys[:1000]], "key binary"), 1 << 20)
    may = held.may_hold(keys)
    assert may[:1000].all() and may[1000:].mean() < 0.02
    full = d.HitFilter(spark.createDataFrame([(k,) for k in keys], "key binary"), 8)
    assert full.words == 1 and full.may_hold(keys).all()
    none = d.HitFilter(spark.createDataFrame([], "key binary"), 8)
    assert not none.may_hold(keys).any()
