import json
from collections import Counter

from pyspark.sql import functions as F

from faultlens.sources.spool import PREFIX, CrashSpool, SpoolStream


def crash(folder, n, **kw):
    data = {"exception_class": f"E{n}", "message": f"m{n}", "backtrace": ["a.rb:1", "b.rb:2"], "timestamp": "2024-01-02T03:04:05Z", "pid": n, "gc": {"count": 3}, "cause_chain": [{"exception_class": "C"}], **kw}
    (folder / f"{PREFIX}{n}.json").write_text(json.dumps({k: v for k, v in data.items() if v is not None}))


def test_batch(spark, tmp_path):
    spark.dataSource.register(CrashSpool)
    for n in range(7):
        crash(tmp_path, n)
    crash(tmp_path, 7, exception_class=None, message=None, timestamp="nonsense", cause_chain=[], backtrace="one line")
    (tmp_path / f"{PREFIX}8.json").write_text("{not json")
    (tmp_path / f"{PREFIX}9.json").write_text("[1]")
    (tmp_path / "other.json").write_text("{}")
    (tmp_path / f"{PREFIX}10.json.failed").write_text("{}")
    rows = {r.file: r for r in spark.read.format("crash_spool").option("filesPerTask", 3).load(str(tmp_path)).collect()}
    assert len(rows) == 10 and sum(r.problem is not None for r in rows.values()) == 2
    first = rows[f"{PREFIX}0.json"]
    assert (first.error_type, first.backtrace, first.platform, first.occurred_at.isoformat()) == ("E0", "a.rb:1\nb.rb:2", "crash_capture", "2024-01-02T03:04:05")
    assert json.loads(first.environment_info) == {"pid": 0, "gc": {"count": 3}, "crash_captured_at": "2024-01-02T03:04:05Z", "source": "crash_capture"}
    bare = rows[f"{PREFIX}7.json"]
    assert (bare.error_type, bare.message, bare.exception_cause, bare.backtrace) == ("UnknownCrash", "Process crash captured via at_exit hook", None, "one line") and bare.occurred_at is not None
    assert len(list(tmp_path.iterdir())) == 12  # nothing is moved
    assert spark.read.format("crash_spool").load(str(tmp_path / "none")).count() == 0


def test_stream_with_restarts_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(CrashSpool)
    spool = tmp_path / "spool"
    spool.mkdir()
    seen = Counter()
    fail = [False]

    def sink(rows, n):
        got = [r.file for r in rows.collect()]
        if fail[0] and got:
            raise RuntimeError("sink is down")
        seen.update(got)

    def run():
        stream = spark.readStream.format("crash_spool").option("maxFilesPerTrigger", 4).option("filesPerTask", 2).load(str(spool))
        q = stream.filter(F.col("file").isNotNull()).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for n in range(6):
        crash(spool, n)
    (spool / f"{PREFIX}bad.json").write_text("oops")
    run()
    assert len(seen) == 7
    fail[0] = True
    crash(spool, 20)
    try:
        run()
    except Exception as e:  # the query's failure
        assert "sink is down" in str(e)
    crash(spool, 21)
    fail[0] = False
    run()
    crash(spool, 22)
    run()
    assert set(seen.values()) == {1} and len(seen) == 10
    left = {p.name for p in spool.iterdir()}
    assert f"{PREFIX}bad.json.failed" in left and f"{PREFIX}bad.json" not in left and f"{PREFIX}0.json" not in left


def test_offsets_name_the_same_files_again(tmp_path):
    for n in range(5):
        crash(tmp_path, n)
    options = {"path": str(tmp_path), "maxFilesPerTrigger": "3"}
    one = SpoolStream(options)
    end = one.latestOffset()
    names = [x for p in one.partitions({"generation": 0}, end) for x in p.value]
    crash(tmp_path, -1)  # comes first by name
    again = SpoolStream(options)
    assert [x for p in again.partitions({"generation": 0}, end) for x in p.value] == names and len(names) == 3
    later = again.latestOffset()
    rest = [x for p in again.partitions(end, later) for x in p.value]
    assert len(rest) == 3 and not set(rest) & set(names) and again.latestOffset() == later
    again.commit(later)
    assert not list(tmp_path.glob("*.json"))
    crash(tmp_path, 0)  # another crash of the same process number
    more = SpoolStream(options).latestOffset()
    assert [x for p in again.partitions(later, more) for x in p.value] == [f"{PREFIX}0.json"]
