"""The queries over hourly partials, with the exact figures in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import catalog
from faultlens.catalog import LOGS
from faultlens.functions.numbers import seconds
from faultlens.plans import rollup
from faultlens.sources import driver
from faultlens.sources.folders import shared_path

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: The end of the last hour, as windows of partials are of whole hours.
END = "2024-01-31 00:00:00"
DAYS = 14


def _table(spark: SparkSession, d: str) -> DataFrame:
    """Partials as a table of two batches, of which the second one has rows for hours of the first."""
    logs = driver.error_logs(spark, d)
    path = shared_path(spark, "partials")
    rollup.added(rollup.hourly(logs.filter("id % 3 > 0")), rollup.hourly(logs.filter("id % 3 = 0"))).write.parquet(path)
    return spark.read.parquet(path)


def _end() -> F.Column:
    return F.lit(END).cast("timestamp_ntz")


ENTRIES["g8_baselines_from_partials"] = (lambda spark, d: rollup.baselines(_table(spark, d), _end()), catalog.ENTRIES["g8_baselines"][1].replace(driver.AS_OF, END))


def _users(spark: SparkSession, d: str) -> DataFrame:
    """Each type's errors and users, and whether the estimate is within three standard errors."""
    recent = driver.error_logs(spark, d).filter(F.col("occurred_at") >= _end() - F.expr(f"interval {DAYS} days"))
    exact = recent.groupBy("error_type").agg(F.count_distinct("user_id").alias("exact"))
    found = rollup.window(_table(spark, d), _end(), DAYS, ["error_type"]).join(exact, "error_type")
    close = F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * (3 * 1.04 / 2 ** (rollup.USERS_LG_K / 2)))
    return found.select("error_type", "n", F.col("exact").alias("users"), close.alias("estimate_is_close"))


ENTRIES["d9_users_from_partials"] = (_users, f"with {LOGS} select error_type, count(*) as n, count(distinct user_id) as users, true as estimate_is_close from logs where occurred_at >= timestamp '{END}' - interval {DAYS} day group by 1")


def _times(spark: SparkSession, d: str) -> DataFrame:
    """Each platform's resolved errors, and whether the quantiles' ranks among their times are within the bound of 2 %."""
    found = rollup.window(_table(spark, d), _end(), DAYS, ["platform"])
    recent = driver.error_logs(spark, d).filter((F.col("occurred_at") >= _end() - F.expr(f"interval {DAYS} days")) & F.col("resolved")).select("platform", (seconds(F.col("occurred_at"), F.col("resolved_at")) / 3600).alias("h"))
    q = found.select(F.col("platform").alias("p"), "median_hours", "p95_hours")
    both = recent.join(q, recent.platform.eqNullSafe(q.p))
    within = lambda c, rank: (F.count_if(F.col("h") < F.col(c)) <= F.count("*") * (rank + 0.02)) & (F.count_if(F.col("h") <= F.col(c)) >= F.count("*") * (rank - 0.02))
    return both.groupBy("platform").agg(F.count("*").alias("resolved"), within("median_hours", 0.5).alias("median_is_close"), within("p95_hours", 0.95).alias("p95_is_close"))


ENTRIES["d36_times_from_partials"] = (_times, f"with {LOGS} select platform, count(*) as resolved, true as median_is_close, true as p95_is_close from logs where occurred_at >= timestamp '{END}' - interval {DAYS} day and resolved group by 1")
