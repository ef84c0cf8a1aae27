from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultlens.operators import filters, grouping, rangejoin, sequences, windows, workflow
from faultlens.plans import crumbs, dashboard, lifecycle, similar
from faultlens.sources import ingest

NOW = datetime(2024, 1, 30, 12)


@pytest.fixture(scope="module")
def as_of(spark):
    return F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")


def occ(spark, rows):
    return spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(rows)], "id long, error_log_id long, occurred_at timestamp_ntz")


def test_bursts(spark):
    def found(times):
        rows = spark.createDataFrame([("A", t) for t in times], "error_type string, occurred_at timestamp_ntz")
        return sorted((r.n, r.duration, r.intensity) for r in sequences.bursts(rows, ["error_type"]).collect())

    at = lambda *s: [NOW + timedelta(seconds=x) for x in s]
    assert found(at(*range(0, 50, 5))) == [(10, 45.0, "medium")]
    assert found(at(*range(0, 60, 10), *range(1000, 1080, 10))) == [(6, 50.0, "low"), (8, 70.0, "low")]
    assert found(at(0, 1, 2, 3)) == []
    assert found(at(0, 60, 120, 180, 240)) == [(5, 240.0, "low")]
    assert found(at(0, 61, 122, 183, 244)) == []


def test_co_occurrence(spark):
    t = lambda m: NOW + timedelta(minutes=m)
    rows = occ(spark, [(1, t(0)), (1, t(60)), (2, t(2)), (2, t(63)), (3, t(5.01)), (4, t(-5)), (4, t(65))])
    assert [tuple(r) for r in rangejoin.co_occurring(rows, 1).collect()] == [(2, 2, 150.0), (4, 2, 0.0)]


def test_cascades(spark, as_of):
    rows = []
    for k in range(4):
        t = NOW + timedelta(hours=k)
        rows += [(1, t), (2, t + timedelta(seconds=30)), (3, t + timedelta(seconds=60)), (4, t)]
    edges = rangejoin.cascades(occ(spark, rows))
    found = {(r.parent_error_id, r.child_error_id): (r.frequency, r.avg_delay_seconds) for r in edges.collect()}
    assert found[1, 2] == (4, 30.0) and found[1, 3] == (4, 60.0) and (1, 4) not in found and (2, 1) not in found
    merged = rangejoin.merged_cascades(edges, edges).filter("parent_error_id = 1 and child_error_id = 2").first()
    assert (merged.frequency, merged.avg_delay_seconds) == (5, 30.0)
    sure = rangejoin.with_probability(edges, occ(spark, rows))
    assert {r.role for r in rangejoin.cascade_neighbours(sure, 2).collect()} == {"parent", "child"}
    assert sure.filter(filters.cascade_scopes()["strong"]).count() == sure.count()


def logs(spark, rows, schema="id long, error_type string, platform string, occurred_at timestamp_ntz, resolved boolean, status string, application_id long, error_hash string"):
    return spark.createDataFrame(rows, schema)


def test_patterns(spark):
    def kind(times):
        r = sequences.cyclical(spark.createDataFrame([("A", t) for t in times], "error_type string, occurred_at timestamp_ntz"), ["error_type"]).first()
        return r.pattern, r.strength

    day = datetime(2024, 1, 15)  # a Monday
    assert kind([day + timedelta(days=d, hours=h) for d in range(5) for h in (9, 10, 11, 12, 13, 14, 15)])[0] == "business_hours"
    assert kind([day + timedelta(days=d, hours=h) for d in range(5) for h in (1, 2, 3)])[0] == "night"
    assert kind([day + timedelta(days=5 + d % 2, hours=8 + d % 14) for d in range(28)])[0] == "weekend"
    flat = kind([day + timedelta(hours=h) for h in range(24)])
    assert flat[0] == "uniform" and flat[1] < 0.3


def test_folding_is_anchored_at_the_first(spark):
    t = lambda h: NOW + timedelta(hours=h)
    rows = spark.createDataFrame([(1, "h", t(x)) for x in (0, 10, 24, 24.5, 40, 49, 49)], "application_id long, error_hash string, occurred_at timestamp_ntz")
    got = sorted((r.first_seen_at, r.last_seen_at, r.occurrence_count) for r in grouping.folded(rows).collect())
    assert got == [(t(0), t(24), 3), (t(24.5), t(40), 2), (t(49), t(49), 2)]


def test_merge_increments_reopens_or_inserts(spark, as_of):
    t = lambda h: NOW + timedelta(hours=h)
    schema = "id long, application_id long, error_hash string, error_type string, message string, occurred_at timestamp_ntz, last_seen_at timestamp_ntz, occurrence_count long, resolved boolean, status string, reopened_at timestamp_ntz"
    stored = spark.createDataFrame([(1, 1, "a", "E", "m", t(-5), t(-5), 3, False, "new", None), (2, 1, "b", "E", "m", t(-90), t(-90), 3, True, "resolved", None), (3, 1, "c", "E", "m", t(-30), t(-30), 3, False, "new", None)], schema)
    batch = spark.createDataFrame([(1, h, "E", "m", t(0)) for h in ("a", "a", "b", "c", "d")], "application_id long, error_hash string, error_type string, message string, occurred_at timestamp_ntz")
    got = {(r.id, r.error_hash): (r.occurrence_count, r.status, r.resolved, r.reopened_at is not None) for r in grouping.merged_groups(stored, batch, as_of).collect()}
    assert got == {(1, "a"): (5, "new", False, False), (2, "b"): (4, "new", False, True), (3, "c"): (3, "new", False, False), (None, "c"): (1, "new", False, False), (None, "d"): (1, "new", False, False)}


def test_throttle(spark):
    rows = spark.createDataFrame([("x", NOW + timedelta(minutes=m)) for m in (0, 5, 5.1, 7, 10.2)], "error_hash string, occurred_at timestamp_ntz")
    assert sorted(r.occurred_at for r in grouping.throttled(rows, ["error_hash"], 5).collect()) == [NOW, NOW + timedelta(minutes=5.1), NOW + timedelta(minutes=10.2)]


def test_filters(spark, as_of):
    rows = logs(spark, [(1, "TypeError", "iOS", NOW, False, "new", 1, "a"), (2, "Other", None, NOW - timedelta(days=1), True, "resolved", 2, "b")])
    ids = lambda **f: sorted(r.id for r in filters.errors_list(rows, f, as_of).collect())
    assert ids() == ids(unresolved="") == ids(unresolved=True) == [1] and ids(unresolved=False) == ids(unresolved="0") == [1, 2]
    assert ids(severity="low", unresolved="false") == [2] and ids(application_id=[2], unresolved=False) == [2]
    assert ids(timeframe="yesterday", unresolved=False) == [2] and ids(timeframe="nonsense") == [1]
    assert ids(assigned_to="x") == ids(hide_muted=True) == [1]  # missing columns say nothing
    assert windows.clamp_days(0) == 1 and windows.clamp_days(9999) == 365


def test_workflow(spark, as_of):
    rows = logs(spark, [(1, "E", None, NOW, False, "new", 1, "a"), (2, "E", None, NOW - timedelta(days=100), False, "wont_fix", 1, "b")])
    done = {r.id: r for r in workflow.resolve(rows, workflow.ids([1]), as_of, by="me").collect()}
    assert done[1].resolved and done[1].status == "resolved" and done[1].resolved_by_name == "me" and not done[2].resolved
    assert {r.id: r.status for r in workflow.set_status(rows, F.lit(True), "investigating").collect()} == {1: "investigating", 2: "wont_fix"}
    children = spark.createDataFrame([(1,), (2,)], "error_log_id long")
    left = workflow.retained(rows, {"c": (children, ["error_log_id"])}, as_of)
    assert [r.id for r in left["error_logs"].collect()] == [1] and [r.error_log_id for r in left["c"].collect()] == [1]
    assert workflow.comments(rows, workflow.ids([2]), "a" * 300, "b", as_of).first().author_name == "a" * 255
    apps = spark.createDataFrame([(1, "x")], "id long, name string")
    assert sorted(r.name for r in workflow.with_applications(apps, spark.createDataFrame([("x",), ("y",), ("y",)], "name string")).collect()) == ["x", "y"]


def test_page_totals_read_crumbs_once(spark, as_of):
    text = '[{"c":"sql","m":"SELECT 1"},{"c":"sql","m":"SELECT 2"},{"c":"sql","m":"SELECT 3"},{"c":"cache","m":"cache read: a","meta":{"hit":"true"}},{"c":"rack_attack","m":"t","meta":{"rule":"r","discriminator":"i"}}]'
    rows = spark.createDataFrame([(1, NOW, text), (2, NOW, "[]")], "id long, occurred_at timestamp_ntz, breadcrumbs string")
    total = crumbs.page_totals(rows, as_of)
    want = {("rack_attack", "unique"): 1, ("rack_attack", "total"): 1, ("rack_attack", "unique_ips"): 1, ("repeated_queries", "unique"): 1, ("repeated_queries", "total"): 3, ("repeated_queries", "affected"): 1, ("cache", "errors"): 1, ("cache", "avg_hit_rate"): 100, ("cache", "total"): 1}
    assert {(r.page, r.measure): r.value for r in total.collect()} == want
    assert total._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    none = {(r.page, r.measure): r.value for r in crumbs.page_totals(rows.filter("id = 2"), as_of).collect()}
    assert none == {("rack_attack", "unique_ips"): 0, ("repeated_queries", "unique"): 0, ("repeated_queries", "total"): None, ("repeated_queries", "affected"): 0, ("cache", "errors"): 0, ("cache", "avg_hit_rate"): None, ("cache", "total"): None}


def test_crumbs_tolerate_what_is_malformed(spark, as_of):
    rows = spark.createDataFrame([(1, NOW, '[{"c":"sql","m":"SELECT 1","d":"2.5"},{"c":"sql","m":"SELECT 2","d":1},{"c":"sql","m":"SELECT 3"}]'), (2, NOW, "{nope"), (3, NOW, None), (4, NOW, '{"c":"sql","m":"x"}'), (5, NOW, "[1, 2]")], "id long, occurred_at timestamp_ntz, breadcrumbs string")
    assert [(r.id, r.n, r.total_ms, r.sample) for r in crumbs.repeated_queries(rows, as_of, 30).collect()] == [(1, 3, 3.5, "SELECT 1")]


def test_release_timeline_first_and_blank_versions(spark, as_of):
    schema = "id long, error_type string, app_version string, git_sha string, error_hash string, occurred_at timestamp_ntz"
    rows = spark.createDataFrame([(i, "E", v, s, h, NOW - timedelta(days=d)) for i, (v, s, h, d) in enumerate([("1", "a", "x", 9), ("1", "", "y", 9), ("2", "b", "x", 5), ("2", None, "z", 5), ("2", "b", "z", 4), ("", "c", "q", 3), (None, "c", "q", 3)])], schema)
    got = {r.app_version: (r.n, r.delta, r.new_errors, r.current, r.shas) for r in lifecycle.release_timeline(rows, as_of).collect()}
    assert got == {"1": (2, None, 2, False, "a"), "2": (3, 1, 1, True, "b")}


def test_empty_tables(spark, as_of):
    none = logs(spark, []).withColumns({"reopened_at": F.lit(None).cast("timestamp_ntz"), "resolved_at": F.lit(None).cast("timestamp_ntz"), "user_id": F.lit(None).cast("long")})
    assert dashboard.counts(none, as_of).first().total_week == 0
    assert dashboard.daily_trend(none, as_of).count() == 8 and dashboard.daily_series(none, as_of).count() == 0
    assert dashboard.by_hour(none, as_of).count() == 24 and lifecycle.mttr(none, as_of).first().mttr_hours == 0.0


def test_similar_errors(spark):
    schema = "id long, error_type string, platform string, message string, backtrace string, backtrace_signature string"
    trace = "/a/x.rb:1:in `f'\n/a/y.rb:2:in `g'"
    rows = spark.createDataFrame([(1, "NoMethodError", "iOS", "no a 1", trace, "s"), (2, "NoMethodError", "iOS", "no a 2", trace, "s"), (3, "NoMethodError", "Android", "no a 1", trace, "s"), (4, "Other", "iOS", "zzz", "/a/q.rb:1", "t")], schema)
    assert [(r.id, r.similarity) for r in similar.similar_errors(rows, 1).collect()] == [(2, 1.0)]


def test_ingest(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"error_type": "E", "message": "password=1 id: 5", "occurred_at": "2024-01-01T00:00:00"}')
    (tmp_path / "b.json").write_text("{broken")
    good, bad = ingest.crash_files(spark, str(tmp_path))
    row = ingest.prepared(good, ignore=["Ignored"]).first()
    assert row.message == "password=[FILTERED] id: 5" and len(row.error_hash) == 16 and row.platform == "API"
    assert bad.count() == 1 and bad.first().file.endswith("b.json")
    assert ingest.prepared(good, ignore=["E"]).count() == 0 and ingest.prepared(good, rate=0.0).count() == 0
    assert '"error_type":"E"' in ingest.payloads(good.withColumn("id", F.lit(1))).first().payload


def test_rate_limit(spark):
    rows = spark.createDataFrame([(i, "ip", NOW + timedelta(seconds=i * 25)) for i in range(4)], "id long, ip string, at_time timestamp_ntz")
    out = sequences.rate_limited(rows, ["ip"], "at_time", F.lit(2), ["at_time", "id"])
    assert sorted(r.id for r in out.filter("limited").collect()) == [2]


def test_reports_without_request_or_type_stay(spark):
    from faultlens.operators.filters import ignored
    from faultlens.sources.ingest import once_per_request

    rows = spark.createDataFrame([("r", "h", "A"), ("r", "h", "A"), (None, "h", "B"), (None, "h", None)], "request_id string, error_hash string, error_type string")
    assert once_per_request(rows).count() == 3
    for given in ((["A"], []), ([], ["^A"]), (["A"], ["^X"])):
        assert sorted(str(r.error_type) for r in rows.filter(~ignored(rows.error_type, *given)).collect()) == ["B", "None"]


def test_runs_and_scans_of_a_hot_key(spark):
    t = lambda *h: [NOW + timedelta(hours=x) for x in h]
    times = t(*range(0, 60, 5), 83.9, 84, 108.5, 200, 224, 224.5)
    rows = spark.createDataFrame([(a, h, x) for a, h in ((1, "x"), (None, "x"), (1, None)) for x in times for _ in range(2)] + [(1, "x", None)], "application_id long, error_hash string, occurred_at timestamp_ntz")

    def plain(window):
        out = []
        for x in times:
            if out and x - out[-1][0] <= window:
                out[-1] = (out[-1][0], x, out[-1][2] + 2)
            else:
                out.append((x, x, 2))
        return out

    for hours in (24, 5, 1):
        window = timedelta(hours=hours)
        found = grouping.folded(rows, window).collect()
        for key in ((1, "x"), (None, "x"), (1, None)):
            assert sorted(tuple(r[2:]) for r in found if tuple(r[:2]) == key) == plain(window)
    runs = grouping.with_runs(rows.filter("application_id = 1 and error_hash = 'x' and occurred_at is not null"), ["application_id", "error_hash"], timedelta(hours=24))
    assert runs.select("_run").distinct().count() == 4 and runs.count() == 2 * len(times)


def test_range_join_meets_each_pair_once(spark):
    import random

    r = random.Random(5)
    at = [NOW + timedelta(microseconds=r.choice([0, 1, 10**6, r.randrange(3 * 10**8)])) for _ in range(150)] + [None]
    rows = occ(spark, [(i % 7, x) for i, x in enumerate(at)])
    left, right = rows.select(F.col("id").alias("a"), F.col("occurred_at").alias("x")), rows.select(F.col("id").alias("b"), F.col("occurred_at").alias("y"))
    for seconds, both in ((60, True), (60, False), (1, True), (0.000001, False), (0.0005, True)):
        got = sorted((p.a, p.b) for p in rangejoin.range_join(left, right, "x", "y", seconds, both).collect())
        span = timedelta(seconds=seconds)
        assert got == [(i, j) for i, x in enumerate(at) for j, y in enumerate(at) if x and y and (abs(y - x) if both else y - x) <= span and (both or y >= x)]


@pytest.mark.parametrize("huge", [False, True])
def test_pair_sums_are_those_of_all_pairs_without_enumerating_them(huge):
    rng = np.random.default_rng(7)
    n, least, most = 3000, 1, 60_000_000
    rows = {"right": rng.random(n) < 0.5, "error": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 400, n)), "us": rng.integers(0, 4 * most, n) // 1_000_000 * 1_000_000, "n": rng.integers(1, 4, n) * (10**5 if huge else 1)}
    want = {}
    a, b = np.flatnonzero(~rows["right"]), np.flatnonzero(rows["right"])
    delay = rows["us"][b][None, :] - rows["us"][a][:, None]
    for i, j in zip(*np.nonzero((delay >= least) & (delay <= most)), strict=True):
        key = (int(rows["error"][a[i]]), int(rows["error"][b[j]]))
        if key[0] != key[1]:
            k = int(rows["n"][a[i]]) * int(rows["n"][b[j]])
            x, y = want.get(key, (0, 0))
            want[key] = (x + k, y + k * int(delay[i, j]))
    got = rangejoin._chunk_sums(least, most)(pa.table(rows)).to_pylist()
    assert {(r["a"], r["b"]): (r["pairs"], int(r["us"])) for r in got} == want


def test_cascades_of_a_dense_minute_take_no_pairs(spark):
    # 160 000 occurrences in a minute: 10 ** 10 pairs
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 375).cast("timestamp_ntz")
    found = rangejoin.cascades(spark.range(160_000).select((F.col("id") % 4).alias("error_log_id"), at.alias("occurred_at"))).collect()
    m = 40_000
    assert {(r.parent_error_id, r.child_error_id): r.frequency for r in found} == {(a, b): m * (m + 1) // 2 if a < b else m * (m - 1) // 2 for a in range(4) for b in range(4) if a != b}
