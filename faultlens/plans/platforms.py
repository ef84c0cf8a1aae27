"""Platforms compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.numbers import percent, round_half_up, seconds
from faultlens.functions.severity import severity
from faultlens.functions.text import truncate
from faultlens.operators.windows import day_spine, days, since
from faultlens.plans.dashboard import health_status

def _hours() -> Column:
    return seconds(F.col("occurred_at"), F.col("resolved_at")) / 3600


def _done() -> Column:
    return F.col("resolved") & F.col("resolved_at").isNotNull()


def severity_distribution(logs: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    return since(logs, as_of, n).groupBy("platform", severity(F.col("error_type")).alias("severity")).agg(F.count("*").alias("n"))


def resolution_times(logs: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    """Mean of each row's hours to two digits; platforms of all time, null where nothing was resolved."""
    every = logs.filter("platform is not null").select("platform").distinct()
    found = since(logs, as_of, n).filter(_done()).groupBy("platform").agg(round_half_up(F.avg(round_half_up(_hours(), 2)), 2).alias("hours"))
    return every.join(found, "platform", "left").select("platform", "hours")


def top_errors(logs: DataFrame, as_of: Column, n: int = 7, k: int = 10) -> DataFrame:
    place = Window.partitionBy("platform").orderBy(F.col("occurrence_count").desc(), "id")
    rows = since(logs, as_of, n).filter("platform is not null").select("platform", "id", "error_type", truncate(F.col("message"), 100).alias("message"), "occurrence_count")
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def stability(logs: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    """Few errors and quick resolutions, against the worst platform. The rows without a platform count among the worst."""
    per = since(logs, as_of, n).groupBy("platform").agg(F.count("*").alias("n"), round_half_up(F.avg(F.when(_done(), round_half_up(_hours(), 2))), 2).alias("h"))
    worst = per.agg(F.max("n").alias("most"), F.max(F.when(F.col("platform").isNotNull(), F.col("h"))).alias("slowest"))
    few = 1 - F.col("n") / F.greatest("most", F.lit(1))
    slow = F.coalesce("slowest", F.lit(0.0))
    quick = F.when(F.coalesce("h", F.lit(0.0)) > 0, 1 - F.col("h") / F.when(slow > 0, slow).otherwise(1.0)).otherwise(1.0)
    return per.filter("platform is not null").join(F.broadcast(worst)).select("platform", round_half_up((0.7 * few + 0.3 * quick) * 100, 1).alias("score"))


def cross_platform(logs: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    per = since(logs, as_of, n).groupBy("error_type", "platform").agg(F.sum("occurrence_count").alias("n"))
    pair = F.when(F.col("platform").isNotNull(), F.concat_ws("=", "platform", F.col("n").cast("string")))
    found = per.groupBy("error_type").agg(F.count("platform").alias("platforms"), F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("by_platform"))
    return found.filter("platforms > 1")


def daily_trends(logs: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    rows = since(logs, as_of, n).filter("platform is not null")
    counted = rows.groupBy("platform", F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))
    spine = day_spine(logs, as_of - days(n), as_of).agg(F.collect_list("day").alias("day"))
    grid = rows.select("platform").distinct().join(F.broadcast(spine)).select("platform", F.explode("day").alias("day"))
    return grid.join(counted, ["platform", "day"], "left").select("platform", "day", F.coalesce("n", F.lit(0)).alias("n"))


def health(logs: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    later = F.col("occurred_at") >= as_of - days(n / 2.0)
    per = since(logs, as_of, n).filter("platform is not null").groupBy("platform").agg(F.count("*").alias("total"), F.count_if(severity(F.col("error_type")) == "critical").alias("critical"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if(later).alias("now"), F.count_if(~later).alias("before"))
    velocity = F.when(F.col("before") != 0, round_half_up((F.col("now") - F.col("before")) * 100.0 / F.when(F.col("before") != 0, F.col("before")).otherwise(1), 1)).otherwise(0.0)
    rows = per.join(stability(logs, as_of, n), "platform")
    return rows.select("platform", "total", "critical", "unresolved", percent(F.col("total") - F.col("unresolved"), F.col("total")).alias("resolution_rate"), velocity.alias("velocity"), F.col("score").alias("stability"), health_status(F.col("score"), F.col("unresolved")).alias("status"))
