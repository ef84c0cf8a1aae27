import random

from pyspark.sql import functions as F

from faultlens.operators import sequences
from faultlens.plans import rollup

DDL = "id long, occurred_at timestamp_ntz, application_id long, error_type string, platform string, user_id long, resolved boolean, resolved_at timestamp_ntz"


def logs(spark, n=6000):
    rng = random.Random(5)
    rows = spark.range(n).select(F.col("id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 37 % 40000).cast("int"))).alias("occurred_at"), (F.col("id") % 3).alias("application_id"), F.concat(F.lit("T"), (F.col("id") % 4).cast("string")).alias("error_type"), F.when(F.col("id") % 5 > 0, F.lit("Web")).alias("platform"), (F.col("id") * rng.randint(5, 9) % 2500).alias("user_id"), (F.col("id") % 2 == 0).alias("resolved"))
    return rows.withColumn("resolved_at", F.when(F.col("resolved"), F.col("occurred_at") + F.make_dt_interval(mins=(F.col("id") % 977).cast("int"))))


def test_baselines_are_those_of_the_errors(spark):
    rows, as_of = logs(spark), F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    parts = [rollup.hourly(rows.filter(f"id % 3 = {i}")) for i in range(3)]
    kept = rollup.added(rollup.added(parts[0], parts[1]), parts[2])
    assert sorted(map(str, rollup.baselines(kept, as_of).collect())) == sorted(map(str, sequences.baselines(rows, as_of).collect()))
    assert kept.count() < 6000


def test_windows_are_close_to_the_exact_figures(spark):
    rows, as_of = logs(spark), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    kept = rollup.added(rollup.hourly(rows.filter("id % 2 = 0")), rollup.hourly(rows.filter("id % 2 = 1")))
    recent = rows.filter("occurred_at >= '2024-01-13' and occurred_at < '2024-01-20'")
    got = {r.error_type: r for r in rollup.window(kept, as_of, 7, ["error_type"]).collect()}
    hours = F.when(F.col("resolved"), F.timestamp_diff("MINUTE", F.col("occurred_at"), F.col("resolved_at")) / 60)
    for r in recent.groupBy("error_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.avg(hours).alias("mean"), F.sort_array(F.collect_list(hours)).alias("h")).collect():
        g = got[r.error_type]
        assert g.n == r.n and abs(g.users - r.users) <= max(1, 0.05 * r.users) and g.resolved == len(r.h)
        if r.h:
            assert abs(g.mean_hours - r["mean"]) < 1e-9
            for q, x in ((0.5, g.median_hours), (0.95, g.p95_hours)):
                below = sum(h < x for h in r.h) / len(r.h)
                assert abs(below - q) < 0.02 + 1 / len(r.h)
        else:
            assert g.median_hours is None


def test_nothing(spark):
    none = rollup.hourly(logs(spark).limit(0))
    assert rollup.added(none, none).count() == 0 and rollup.baselines(none, F.lit("2024-01-20").cast("timestamp_ntz")).count() == 0
