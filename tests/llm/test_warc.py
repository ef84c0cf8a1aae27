import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from faultlens.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, key int"


def rows():
    rng = random.Random(6)
    out = [(i, f"http://x/{i}", "".join(rng.choice("abc<>é\r\n ") for _ in range(rng.choice([1, 50, 3000]))), "x", 1) for i in range(200)]
    return out + [(300, None, None, "x", 1), (301, "u\r\nv", "", "x", 1), (302, "u", out[5][2], "x", 1), (303, "u", out[5][2], "x", 1), (304, "u", "z" * 300_000, "x", 1)]


def brute(data, least=0):
    groups = defaultdict(list)
    for i, _, t, *_ in data:
        groups[(t or "").encode()].append(i)
    out = []
    for body, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for i in ids:
            again = i != min(ids) and len(body) >= least
            out.append((i, len(body), digest, "revisit" if again else "response", min(ids) if again else None))
    return sorted(out)


@pytest.mark.parametrize("size", [200, 10_000_000])
def test_round_trip(spark, tmp_path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        warc.write_warc(spark.createDataFrame(rows()[:60] + rows()[-5:], SCHEMA), str(tmp_path / "a"))
        got = warc.read_warc(spark, str(tmp_path / "a"))
        found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
        assert sorted(found) == brute(rows()[:60] + rows()[-5:])
        texts = {r.page_id: bytes(r.payload).decode() for r in got.filter("record_type = 'response'").collect()}
        assert all(texts[i] == (t or "") for i, _, t, *_ in rows()[:60] if i in texts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_are_gzip(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(rows()[:20], SCHEMA).coalesce(1), str(tmp_path / "a"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == 20


def test_magic_inside_members(spark, tmp_path):
    """Stored members hold the magic itself; ranges of every size cut them anywhere."""
    def member(i):
        payload = b"".join(warc.MAGIC + bytes([k % 256]) * 9 for k in range(i))
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return gzip.compress(head + payload + b"\r\n\r\n", compresslevel=0), (i, len(payload), warc.base32_sha1(payload))

    made = [member(i) for i in range(40)]
    path = tmp_path / "archive.warc"
    path.write_bytes(b"".join(m for m, _ in made) + made[3][0][:-20])  # the last is cut off
    for size in (97, 1000, 5_000, 10_000_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = warc.read_warc(spark, str(path)).collect()
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == [w for _, w in made], size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


#: A record as zlib compressed it, with the magic at byte 27, before the first byte comes out.
EARLY = base64.b64decode(
    "H4sIAAAAAAAAA12PzWqDQBzE74Lv8H8BoxuNH4sIJkKwKUHEYprbJm7VNtnd7q5t7dPHFHtoYQ7D8JuBqdNyY6MFMo16clY1CopBUiU4U3QOS3rmsrHyDEM8SIYFaSmOfJT8lohsqbaeyhxDp7XAtk0WJ9sL3WgmMqKn"
    "WRQFjuWgSZXj4B8dZ6Ag44WTxsr6liqNQXUEYXe7zIPtOtvtV+uHQ33wntN96h6XVbVbFXXh/+s+UtbqDoPvmcaGM02Z/pOZRiwS3VF4H/rzG5wk/2Twwr8gDEJ4Ha5CAf+gEu7IhXyP0PAWppug+ytVsS2S+8YNU9TeBzEBAAA="
)


def test_magic_before_the_first_byte(spark, tmp_path):
    assert EARLY.find(warc.MAGIC, 3) == 27
    plain = [warc.build_record(i, "u", b"payload %d" % i, None, 6) for i in range(3)]
    fields = [b"\x08" + bytes(4) + b"\0\x03" + name + b"\0" for name in (warc.MAGIC, warc.MAGIC * 3, b"a" + warc.MAGIC * 2 + b"b")]  # the header's file name
    named = [warc.MAGIC + f + m[10:] for f, m in zip(fields, plain, strict=True)]
    made = [EARLY, warc.EMPTY_MEMBER, named[0], warc.EMPTY_MEMBER, EARLY[:40], named[1], EARLY[:-9], named[2], warc.EMPTY_MEMBER, EARLY]
    path = tmp_path / "archive.warc"
    path.write_bytes(b"".join(made))
    assert gzip.decompress(named[2]) == gzip.decompress(plain[2])
    for size in (41, 97, 300, 10_000_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = warc.read_warc(spark, str(path)).collect()
        assert sorted((r.page_id, r.payload_bytes) for r in got) == [(0, 9), (1, 9), (2, 9), (961, 64), (961, 64)], size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_least_payload_and_empty(spark, tmp_path):
    data = [(1, "u", "same", "x", 1), (2, "u", "same", "x", 1), (2, "u", "same", "x", 1)]
    warc.write_warc(spark.createDataFrame(data, SCHEMA), str(tmp_path / "a"), min_payload=5)
    assert [r.record_type for r in warc.read_warc(spark, str(tmp_path / "a")).collect()] == ["response"] * 3
    warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))
    assert warc.read_warc(spark, str(tmp_path / "b")).count() == 0


def test_damaged_and_wrong_records_are_dropped(spark, tmp_path):
    good = [warc.build_record(i, "u", b"payload %d" % i * 40, None, 6) for i in range(9)]
    bent = bytearray(good[4])
    bent[len(bent) // 2] ^= 0xFF  # in the middle of the archive, and of most ranges
    wrong = gzip.compress(gzip.decompress(good[6]).replace(b"payload 6", b"payload 7"))
    path = tmp_path / "archive.warc"
    path.write_bytes(b"".join([*good[:4], bytes(bent), good[5], wrong, *good[7:]]))
    for size in (61, 10_000_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert sorted(r.page_id for r in warc.read_warc(spark, str(path)).collect()) == [0, 1, 2, 3, 5, 7, 8], size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_extra_columns_that_clash(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "x", "a", 7, "b"), (2, "u", "x", "c", 8, "d")], "page_id long, url string, html string, payload string, first int, size string")
    warc.write_warc(table, str(tmp_path / "a"))
    got = warc.read_warc(spark, str(tmp_path / "a"), payload=False)
    assert got.columns == ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    assert sorted((r.page_id, r.refers_to) for r in got.collect()) == [(1, None), (2, 1)]


def test_query_against_sql_with_null_ids(spark, tmp_path):
    import duckdb

    from faultlens.llm import queries

    rows = [(1, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "u", "alone"), (None, "v", "twice"), (None, "w", "twice"), (4, None, None), (3, "x", ""), (2, "y", "<p>a</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op10_warc"])
    names = [c[0] for c in want.description]
    got = queries.op10_warc(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))
