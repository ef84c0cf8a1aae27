"""Versions, users, hours and periods set against each other; each is one grouped plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.numbers import change, correlation_strength, pearson, percent, round_half_up, trend_direction
from faultlens.functions.severity import severity
from faultlens.operators.windows import days, since

def _critical() -> Column:
    return severity(F.col("error_type")) == "critical"


def _sorted(name: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(name)), ",")


def by_version(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    rows = since(logs, as_of, n).filter("app_version is not null")
    return rows.groupBy("app_version").agg(F.count("*").alias("n"), F.count_distinct("error_type").alias("types"), F.count_if(_critical()).alias("critical"), _sorted("platform").alias("platforms"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))


def by_sha(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    rows = since(logs, as_of, n).filter("git_sha is not null")
    return rows.groupBy("git_sha").agg(F.count("*").alias("n"), F.count_distinct("error_type").alias("types"), F.count_if(_critical()).alias("critical"), _sorted("app_version").alias("versions"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))


def problematic_releases(logs: DataFrame, as_of: Column, n: int = 30, factor: float = 2.0) -> DataFrame:
    """Versions with more than ``factor`` times the mean of all versions."""
    v = by_version(logs, as_of, n).select("app_version", "n", "critical")
    mean = v.agg(F.avg("n").alias("mean"))
    found = v.join(F.broadcast(mean), F.col("n") > F.col("mean") * factor)
    return found.select("app_version", "n", "critical", round_half_up((F.col("n") - F.col("mean")) / F.col("mean") * 100, 1).alias("deviation"))


def multi_error_users(logs: DataFrame, as_of: Column, n: int = 30, least: int = 2) -> DataFrame:
    per = since(logs, as_of, n).filter("user_id is not null").groupBy("user_id", "error_type").agg(F.count("*").alias("n"))
    users = per.groupBy("user_id").agg(F.count("*").alias("types"), F.sum("n").alias("total"), _sorted("error_type").alias("error_types"))
    return users.filter(F.col("types") >= least)


def user_overlap(logs: DataFrame, as_of: Column, a: str, b: str, n: int = 30) -> DataFrame:
    """How many users two types share, as a share of the smaller set."""
    per = since(logs, as_of, n).filter(F.col("error_type").isin(a, b) & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.bool_or(F.col("error_type") == a).alias("a"), F.bool_or(F.col("error_type") == b).alias("b"))
    one = per.agg(F.count_if("a").alias("users_a"), F.count_if("b").alias("users_b"), F.count_if(F.col("a") & F.col("b")).alias("overlap"))
    return one.select("users_a", "users_b", "overlap", percent(F.col("overlap"), F.least("users_a", "users_b")).alias("percentage"))


def platform_specific(logs: DataFrame, as_of: Column, n: int = 30, k: int = 5) -> DataFrame:
    """Top types of each platform, with the other platforms that have them."""
    per = since(logs, as_of, n).filter("platform is not null").groupBy("platform", "error_type").agg(F.count("*").alias("n"))
    place = Window.partitionBy("platform").orderBy(F.col("n").desc(), "error_type")
    top = per.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    everywhere = per.groupBy("error_type").agg(F.collect_set("platform").alias("all"))
    others = F.array_sort(F.array_except("all", F.array("platform")))
    return top.join(everywhere, "error_type").select("platform", "error_type", "n", F.array_join(others, ",").alias("others"), (F.size(others) == 0).alias("platform_specific"))


def time_correlated(logs: DataFrame, as_of: Column, n: int = 30, least: float = 0.5, blocks: int = 16) -> DataFrame:
    """Pairs of types whose counts by hour of day go together.

    A type is a vector of 24 counts. Types are dealt to ``blocks`` by hash, and pairs of blocks are the keys of the join, so that a task has the
    types of two blocks, whatever hours they have.
    """
    hour = F.hour("occurred_at")
    per = since(logs, as_of, n).groupBy("error_type").agg(F.array(*[F.count_if(hour == h).cast("double") for h in range(24)]).alias("v"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    types = per.select("error_type", "v", total(F.col("v")).alias("s"), total(F.transform("v", lambda x: x * x)).alias("ss"), F.pmod(F.xxhash64("error_type"), F.lit(blocks)).alias("own"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = types.select(F.col("error_type").alias("type_a"), F.col("v").alias("x"), F.col("s").alias("sx"), F.col("ss").alias("sxx"), F.col("own").alias("block_a"), each.alias("block_b"))
    b = types.select(F.col("error_type").alias("type_b"), F.col("v").alias("y"), F.col("s").alias("sy"), F.col("ss").alias("syy"), F.col("own").alias("block_b"), each.alias("block_a"))
    both = a.join(b, ["block_a", "block_b"]).filter("type_a < type_b")
    r = pearson(F.lit(24.0), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), total(F.zip_with("x", "y", lambda x, y: x * y)))
    return both.select("type_a", "type_b", r.alias("correlation")).filter(F.col("correlation") > least).withColumn("strength", correlation_strength(F.col("correlation")))


def period_comparison(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """The later half against the one before it."""
    half, at = n // 2, F.col("occurred_at")
    one = logs.agg(F.count_if(at >= as_of - days(half)).alias("current"), F.count_if((at >= as_of - days(2 * half)) & (at < as_of - days(half))).alias("previous"))
    pct = change(F.col("current"), F.col("previous"))
    return one.select("current", "previous", (F.col("current") - F.col("previous")).alias("change"), pct.alias("change_percentage"), trend_direction(pct).alias("trend"))
