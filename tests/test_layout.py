import datetime as dt
import re
from pathlib import Path

from pyspark.sql import functions as F

from faultlens.sources import layout

DDL = "id long, occurred_at timestamp_ntz, application_id long"


def logs(spark):
    start = dt.datetime(2024, 1, 1, 6)
    rows = [(i, start + dt.timedelta(hours=5 * i), i % 3) for i in range(60)] + [(100, None, 1), (7, start, 1)]
    return spark.createDataFrame(rows, DDL)


def plan(df):
    return df._jdf.queryExecution().toString()


def files(path):
    return {p.parent.name + "/" + p.name for p in Path(path).rglob("*.parquet")}


def test_a_window_reads_its_days_only(spark, tmp_path):
    path = str(tmp_path / "daily")
    layout.write_daily(logs(spark), path)
    as_of = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    got = layout.since_daily(layout.read_daily(spark, path, DDL), as_of, 2.5, [0, 1])
    assert re.search(r"PartitionFilters: \[isnotnull\(occurred_date#\d+\), \(occurred_date#\d+ >= 2024-01-08\)\]", plan(got))
    want = logs(spark).filter("occurred_at >= '2024-01-08 00:00:00' and application_id in (0, 1)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and layout.read_daily(spark, path, DDL).count() == 62


def test_a_change_rewrites_the_days_it_touches(spark, tmp_path):
    path = str(tmp_path / "daily")
    layout.write_daily(logs(spark), path)
    before = files(path)
    layout.changed(spark, path, DDL, "2024-01-03", "2024-01-04", lambda t: t.withColumn("application_id", F.lit(9).cast("long")))
    after = files(path)
    other = {f for f in before if not f.startswith(("occurred_date=2024-01-03", "occurred_date=2024-01-04"))}
    assert other <= after and not (before - other) & after
    got = layout.read_daily(spark, path, DDL)
    assert got.filter("application_id = 9").count() == got.filter("occurred_date between '2024-01-03' and '2024-01-04'").count() > 0
    layout.changed(spark, path, DDL, "2024-01-03", "2024-01-03", lambda t: t.limit(0))  # a day without rows left
    assert not (Path(path) / "occurred_date=2024-01-03").exists() and layout.read_daily(spark, path, DDL).count() < 62


def test_retention_drops_days_and_cuts_one(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("error_logs", "comments", "edges")}
    all_logs = logs(spark).filter("not (id = 7 and application_id = 1 and occurred_at = '2024-01-01 06:00:00')")
    comments = all_logs.select(F.col("id").alias("error_log_id")).union(spark.createDataFrame([(999,)], "error_log_id long"))
    edges = all_logs.select(F.col("id").alias("parent_error_id"), ((F.col("id") * 7) % 60).alias("child_error_id"))
    layout.write_daily(all_logs, at["error_logs"])
    layout.write_children(comments, all_logs, at["comments"])
    layout.write_children(edges, all_logs, at["edges"], "parent_error_id")
    before = files(at["comments"])
    tables = {"error_logs": (at["error_logs"], DDL, "id"), "comments": (at["comments"], "error_log_id long", "error_log_id"), "edges": (at["edges"], "parent_error_id long, child_error_id long", "parent_error_id,child_error_id")}
    assert layout.retained_daily(spark, tables, "2024-01-13 13:00:00", 5) == {"comments": 7, "edges": 0, "error_logs": 7}
    left = {r.id for r in all_logs.filter("occurred_at is null or occurred_at >= '2024-01-08 13:00:00'").collect()}
    read = lambda n: layout.read_daily(spark, *tables[n][:2])
    assert {r.id for r in read("error_logs").collect()} == left
    assert {r.error_log_id for r in read("comments").collect()} == left | {999}
    assert {tuple(r)[:2] for r in read("edges").collect()} == {(r.parent_error_id, r.child_error_id) for r in edges.collect() if {r.parent_error_id, r.child_error_id} <= left}
    later = {f for f in before if f[len("occurred_date=") :] > "2024-01-09"}
    assert later <= files(at["comments"])  # later days and the folder of no day are as they were
    assert layout.retained_daily(spark, tables, "2024-01-13 13:00:00", 5)["comments"] == 0


def test_eager_loading_shuffles_nothing(spark):
    errors = spark.range(500).withColumn("kind", F.lit("E"))
    comments = spark.range(1000).selectExpr("id % 300 as error_log_id", "'c' || id as body", "timestamp_seconds(id) as created_at")
    seen = spark.range(3000).selectExpr("id % 400 as error_log_id", "timestamp_seconds(id) as occurred_at")
    made = [layout.bucketed(t, c, 4) for t, c in ((errors, "id"), (comments, "error_log_id"), (seen, "error_log_id"))]
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = layout.eager_loaded(*made)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        rows = {r.id: (r.comments, r.last_comment, r.occurrences) for r in got.collect()}
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert len(rows) == 500 and rows[0] == (4, "c900", 8) and rows[350] == (0, None, 7) and rows[450] == (0, None, 0)
