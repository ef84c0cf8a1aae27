from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultlens.operators import upsert as u
from faultlens.sources.ingest import REPORT
from faultlens.streaming.ingest import ingested, report_events
from faultlens.streaming.store import Dispatcher, Sink, Store

EVENTS = "application_id long, error_hash string, " + u.EVENT_DDL
GROUPS = "application_id long, error_hash string, " + u.GROUP_DDL
S = 1_000_000


def outcome(spark, *events, groups=None):
    rows = [(1, h, at * S, kind, None, 3, f'{{"error_type":"E","message":"m{at}","user_id":{at}}}') for h, at, kind in events]
    return u.outcomes(groups if groups is not None else spark.createDataFrame([], GROUPS), spark.createDataFrame(rows, EVENTS))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.write(outcome(spark, ("a", 1, "occurrence"), ("a", 2, "occurrence"), ("b", 3, "occurrence"), ("b", 4, "mute")), 0)
    return s


def shown(store):
    return {t: sorted(map(str, store.table(t).collect())) for t in ("occurrences", "groups", "notifications", "created")}


def test_a_batch_that_comes_again_changes_nothing(spark, store):
    first = shown(store)
    assert len(first["occurrences"]) == 3 and len(first["notifications"]) == 2 and len(first["created"]) == 2
    assert store.write(outcome(spark, ("c", 9, "occurrence")), 0) is False and shown(store) == first
    # a batch that failed before its row in the ledger isn't seen, and its next attempt replaces what it wrote
    whole = store._put
    store._put = lambda rows, table, n: (_ for _ in ()).throw(OSError("lost")) if table == "ledger" else whole(rows, table, n)
    with pytest.raises(OSError):
        store.write(outcome(spark, ("c", 9, "occurrence"), ("d", 9, "occurrence")), 1)
    assert shown(store) == first
    store._put = whole
    assert store.write(outcome(spark, ("c", 9, "occurrence")), 1)
    assert Counter(r.batch_id for r in store.table("occurrences").collect()) == {0: 3, 1: 1}


def test_an_empty_batch_replaces_a_failed_one(spark, store):
    store._put(spark.createDataFrame([(5, None, 1, "r", "s")], "error_log_id long, occurred_at timestamp_ntz, user_id long, request_id string, session_id string"), "occurrences", 1)
    store.write(outcome(spark, ("zz", 5, "resolve")), 1)
    assert store.table("occurrences").filter("batch_id = 1").count() == 0 and store.done(1)


def test_groups_are_as_the_last_batch_left_them(spark, store):
    base = spark.createDataFrame([(9, "old", 77, 0, 0, 5, True, "resolved", False, None), (9, "older", 78, 0, 0, 5, True, "resolved", False, None)], GROUPS)
    again = [(9, "old", 7 * S, "occurrence", None, 3, "{}"), (1, "a", 8 * S, "occurrence", None, 3, "{}")]
    store.write(u.outcomes(store.groups(base), spark.createDataFrame(again, EVENTS)), 1)
    got = {r.error_hash: (r.id, r.occurrence_count, r.status, r.muted) for r in store.groups(base).collect()}
    assert got["old"] == (77, 6, "new", False) and got["older"] == (78, 5, "resolved", False)
    assert got["a"][1:] == (3, "new", False) and got["b"][1:] == (1, "new", True)


def test_sinks_fail_apart_and_nothing_is_sent_twice(spark, store):
    got, broken = Counter(), [True]

    def pager(rows):
        if broken[0]:
            raise ConnectionError("down")
        got.update(("pager", r.delivery_id) for r in rows.collect())

    chat = Sink("chat", lambda rows: got.update(("chat", r.delivery_id) for r in rows.collect()))
    hooks = Sink("plugin", lambda rows: got.update(("plugin", r.hook, r.error_log_id) for r in rows.collect()), hooks=("on_error_logged", "on_error_recurred", "on_error_muted"))
    off = Sink("off", lambda rows: got.update(["off"]), enabled=False)
    d = Dispatcher(store, [Sink("pager", pager), chat, hooks, off])
    assert d.dispatch() == {"pager": 0, "chat": 1, "plugin": 1} and "down" in d.failures["pager"]
    store.write(outcome(spark, ("c", 9, "occurrence")), 1)
    assert d.dispatch() == {"pager": 0, "chat": 1, "plugin": 1}
    broken[0] = False
    assert d.dispatch() == {"pager": 2, "chat": 0, "plugin": 0} and not d.failures
    assert Dispatcher(store, [Sink("pager", pager), chat, hooks]).dispatch() == {"pager": 0, "chat": 0, "plugin": 0}
    assert set(got.values()) == {1} and Counter(k[0] for k in got) == {"pager": 3, "chat": 3, "plugin": 5}
    with pytest.raises(ValueError, match="same name"):
        Dispatcher(store, [chat, chat])


def test_reports_to_store_as_a_stream_with_a_restart(spark, tmp_path):
    names = [c.split()[0] for c in REPORT.split(", ")]
    report = lambda i, kind, minute: {**dict.fromkeys(names), "error_type": kind, "message": f"failed for {i} a@b.cd password=x{i}", "application_id": 1, "user_id": i, "request_id": f"r{i}", "occurred_at": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00"}
    rows = [report(i, "ArgumentError" if i % 3 else "TypeError", 10 * i) for i in range(30)] + [{**report(99, "Quiet", 5), "handled": True, "level": "warning"}]
    tick = report(1000, "Clock", 60 * 23)
    schema = spark.createDataFrame([], REPORT).schema
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    sent = Counter()
    dispatch = Dispatcher(store, [Sink("s", lambda r: sent.update(x.delivery_id for x in r.collect()))])

    def run():
        reports = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = store.sink(ingested(reports, late="30 minutes"), str(tmp_path / "cp"), dispatch.dispatch).trigger(availableNow=True).start()
        q.awaitTermination(150)
        assert not q.isActive

    import json

    for n, part in enumerate((rows[:12], rows[12:], [tick])):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        if n != 1:
            run()
    batch = u.outcomes(spark.createDataFrame([], GROUPS), report_events(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(c.replace("occurred_at timestamp_ntz", "occurred_at string") for c in REPORT.split(", "))).withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))).drop("at"))
    key = lambda df: sorted(map(str, df.select("application_id", "error_hash", "id", "first_us", "last_us", "occurrence_count").collect()))
    assert key(store.groups()) == key(u.latest(batch)) and store.table("occurrences").count() == 30
    assert sum(sent.values()) == len(sent) == batch.filter("notify").count() > 0
    kept = store.table("created").select("message").collect()
    assert kept and all("password=x" not in r.message for r in kept)
