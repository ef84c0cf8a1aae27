from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultlens.operators import grouping
from faultlens.streaming import live

NOW = datetime(2024, 1, 30, 12)


@pytest.fixture()
def drive(spark, tmp_path):
    """Runs a stream over tables given one after the other; returns the rows that it emits."""

    def run(batches, schema, build, mode="append"):
        src, n = tmp_path / "src", [0]
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
            stream = spark.readStream.schema(schema).parquet(str(src))
            q = build(stream).writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(120), "the stream doesn't end"
            n[0] += 1
        return spark.read.parquet(str(tmp_path / "out"))

    return run


def test_grouping_is_the_same_as_in_batch(spark, drive):
    t = lambda h: NOW + timedelta(hours=h)
    schema = "application_id long, error_hash string, at timestamp"
    parts = [[(1, "h", t(0)), (1, "h", t(3)), (2, "h", t(1))], [(1, "h", t(24)), (1, "h", t(25))], [(1, "h", t(60))]]
    out = drive(parts, schema, live.grouped)
    last = out.groupBy("application_id", "error_hash", "first_us").agg(F.max("occurrence_count").alias("n")).collect()
    every = spark.createDataFrame([r for p in parts for r in p], schema).withColumn("occurred_at", F.col("at").cast("timestamp_ntz"))
    assert sorted((r.application_id, r.n) for r in last) == sorted((r.application_id, r.occurrence_count) for r in grouping.folded(every).collect())


def test_rows_out_of_order_in_one_batch(spark, drive):
    t = lambda h: NOW + timedelta(hours=h)
    schema = "application_id long, error_hash string, at timestamp"
    out = drive([[(1, "h", t(h)) for h in (30, 0, 25, 3, 50, 24)]], schema, live.grouped)
    every = spark.createDataFrame([(1, "h", t(h)) for h in (30, 0, 25, 3, 50, 24)], schema).withColumn("occurred_at", F.col("at").cast("timestamp_ntz"))
    assert sorted(r.occurrence_count for r in out.collect()) == sorted(r.occurrence_count for r in grouping.folded(every).collect())


def test_throttle(drive):
    at = lambda m: NOW + timedelta(minutes=m)
    out = drive([[("x", at(0)), ("x", at(2))], [("x", at(5)), ("x", at(5.5)), ("y", at(6))]], "error_hash string, at timestamp", live.throttled)
    us = lambda m: (at(m) - datetime(1970, 1, 1, tzinfo=at(m).tzinfo)) // timedelta(microseconds=1)
    assert sorted((r.error_hash, r.at_us) for r in out.collect()) == [("x", us(0)), ("x", us(5.5)), ("y", us(6))]


def test_hourly_counters(drive):
    at = lambda m: NOW + timedelta(minutes=m)
    schema = "exception_class string, raise_location string, rescue_location string, kind string, at timestamp"
    out = drive([[("E", "f:1", "f:2", "raise", at(1)), ("E", "f:1", "f:2", "rescue", at(2)), ("E", "f:1", "f:2", "raise", at(61))], [("E", "f:1", "f:2", "raise", at(300))], [("E", "f:1", "f:2", "raise", at(301))]], schema, live.swallowed_counters)
    assert sorted((r.raise_count, r.rescue_count) for r in out.collect()) == [(1, 0), (1, 1)]


def test_bursts(drive):
    at = lambda s: NOW + timedelta(seconds=s)
    out = drive([[("A", at(10 * i)) for i in range(6)], [("A", at(10_000))], [("A", at(10_001))]], "error_type string, at timestamp", live.bursts)
    assert [(r.error_type, r.n) for r in out.collect()] == [("A", 6)]
