"""Cyclical patterns, bursts, rate limits and statistical baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.numbers import anomaly_level, burst_intensity, deviations_above, round_half_up, seconds
from faultlens.operators.windows import day_start, days, since


def cyclical(logs: DataFrame, keys: list[str]) -> DataFrame:
    """By key: hours of the day and days of the week, the kind of pattern and how strong it is."""
    per = logs.groupBy(*keys, F.hour("occurred_at").alias("hour"), (F.dayofweek("occurred_at") - 1).alias("weekday")).agg(F.count("*").alias("n"))
    hours = per.groupBy(*keys, "hour").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("weekday").isin(0, 6), F.col("n")).otherwise(0)).alias("weekend"))
    all_ = hours.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("weekend").alias("weekend"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.array_sort(F.collect_list(F.struct("hour", "n"))).alias("hours"))
    mean = F.col("total") / 24.0
    peaks = F.transform(F.filter("hours", lambda h: h["n"] > 2 * mean), lambda h: h["hour"])
    within = lambda a, z: F.size(F.filter(peaks, lambda h: h.between(a, z)))
    kind = F.when(within(9, 17) >= 3, "business_hours").when(within(0, 6) >= 2, "night").when(F.col("weekend") * 100 > F.col("total") * 50, "weekend").otherwise("uniform")
    spread = F.sqrt(F.greatest(F.col("squares") / 24.0 - mean * mean, F.lit(0.0)))
    strength = F.least(round_half_up(spread / mean, 2), F.lit(1.0))
    return all_.select(*keys, "total", kind.alias("pattern"), strength.alias("strength"), F.array_join(F.array_sort(peaks), ",").alias("peak_hours"))


def bursts(logs: DataFrame, keys: list[str], gap: float = 60, least: int = 5) -> DataFrame:
    """Stretches in which each event follows the one before within ``gap`` seconds, of at least ``least`` events.

    Spark's session windows merge on the way to the shuffle, so a hot key is a few rows per task.
    """
    per = logs.groupBy(*keys, F.session_window(F.col("occurred_at"), f"{int(gap)} seconds")).agg(F.min("occurred_at").alias("start"), F.max("occurred_at").alias("end"), F.count("*").alias("n"))
    found = per.filter(F.col("n") >= least)
    return found.select(*keys, "start", "end", "n", round_half_up(seconds(F.col("start"), F.col("end")), 1).alias("duration"), burst_intensity(F.col("n")).alias("intensity"))


def of_error(logs: DataFrame, error_id: int, as_of: Column, n: int) -> DataFrame:
    """Rows of the last n days with one error's type and platform, for ``cyclical`` and ``bursts``."""
    one = logs.filter(F.col("id") == error_id).select(F.col("error_type").alias("_t"), F.col("platform").alias("_p"))
    same = F.col("error_type").eqNullSafe(F.col("_t")) & F.col("platform").eqNullSafe(F.col("_p"))
    return since(logs, as_of, n).join(one, same, "left_semi")


def rate_limited(requests: DataFrame, keys: list[str], at: str, limit: Column, order: list[str]) -> DataFrame:
    """Requests with their number in the calendar minute of their key, and whether they exceed the limit."""
    minute = F.date_trunc("MINUTE", F.col(at)).cast("timestamp_ntz")
    w = Window.partitionBy(*keys, "minute").orderBy(*order)
    return requests.withColumn("minute", minute).withColumn("at", F.row_number().over(w)).withColumn("limited", F.col("at") > limit)


KEY = ["error_type", "platform"]
PERIODS = {"hourly": (28, lambda t: F.hour(t).cast("string")), "daily": (84, lambda t: F.date_format(t, "yyyy-MM-dd")), "weekly": (365, lambda t: F.concat_ws("-", F.year(t).cast("string"), F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("string")))}


def statistics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation and percentiles of ``n`` by key, without what is more than three deviations off where there are three samples."""
    w = Window.partitionBy(*keys)
    marked = samples.withColumn("_m", F.avg("n").over(w)).withColumn("_s", F.stddev_pop("n").over(w)).withColumn("_k", F.count("*").over(w))
    kept = marked.filter((F.col("_k") < 3) | (F.abs(F.col("n") - F.col("_m")) <= 3 * F.col("_s")))
    two = lambda c: round_half_up(c, 2)
    return kept.groupBy(*keys).agg(F.sum("n").alias("count"), two(F.avg("n")).alias("mean"), two(F.stddev_pop("n")).alias("std_dev"), two(F.percentile("n", F.lit(0.95))).alias("percentile_95"), two(F.percentile("n", F.lit(0.99))).alias("percentile_99"), F.count("*").alias("sample_size"))


def baselines(logs: DataFrame, as_of: Column) -> DataFrame:
    """Hourly, daily and weekly baselines of every type and platform. A period without errors is no sample."""
    out = None
    for kind, (n, bucket) in PERIODS.items():
        counted = since(logs, as_of, n).groupBy(*KEY, bucket(F.col("occurred_at")).alias("period")).agg(F.count("*").cast("double").alias("n"))
        one = statistics(counted.withColumn("baseline_type", F.lit(kind)), [*KEY, "baseline_type"])
        out = one if out is None else out.unionByName(one)
    return out


def nearest_baseline(base: DataFrame, latest: str | None = None) -> DataFrame:
    """Of each type and platform the hourly baseline, else the daily, else the weekly; of one kind the latest."""
    rank = F.when(F.col("baseline_type") == "hourly", 0).when(F.col("baseline_type") == "daily", 1).otherwise(2)
    order = [rank, F.col(latest).desc()] if latest else [rank]
    return base.withColumn("_at", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).filter("_at = 1").drop("_at")


def anomalies(logs: DataFrame, base: DataFrame, as_of: Column, sensitivity: int = 2) -> DataFrame:
    """Today's counts against the nearest baseline."""
    today = logs.filter(F.col("occurred_at") >= day_start(as_of)).groupBy(*KEY).agg(F.count("*").alias("today"))
    b = nearest_baseline(base).select(*[F.col(c).alias(f"_{c}") for c in KEY], "baseline_type", "mean", "std_dev")
    rows = today.join(b, (F.col("error_type") == F.col("_error_type")) & F.col("platform").eqNullSafe(F.col("_platform")))
    x = F.col("today").cast("double")
    return rows.select(*KEY, "today", "baseline_type", "mean", "std_dev", anomaly_level(x, F.col("mean"), F.col("std_dev"), sensitivity).alias("level"), round_half_up(deviations_above(x, F.col("mean"), F.col("std_dev")), 2).alias("deviations"), (x > F.col("mean") + sensitivity * F.col("std_dev")).alias("exceeds"))


def upserted_baselines(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with the same key; a null is a value of a key."""
    taken = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return old.join(taken, same, "left_anti").unionByName(new, allowMissingColumns=True)


def recurring_patterns(logs: DataFrame, as_of: Column, n: int = 30, k: int = 5, strength: float = 0.6) -> DataFrame:
    """Of the most frequent types those with a strong pattern."""
    recent = since(logs, as_of, n)
    top = recent.groupBy("error_type").agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), "error_type").limit(k)
    return cyclical(recent.join(F.broadcast(top), "error_type", "left_semi"), ["error_type"]).filter(F.col("strength") > strength)


def pattern_insights(logs: DataFrame, as_of: Column, n: int = 30, k: int = 5) -> DataFrame:
    """Top types with their commonest platform, pattern and number of bursts in the last week at most."""
    recent = since(logs, as_of, n)
    top = recent.groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "error_type").limit(k)
    own = recent.join(F.broadcast(top.select("error_type")), "error_type", "left_semi")
    per = own.filter("platform is not null").groupBy("error_type", "platform").agg(F.count("*").alias("k"))
    mode = per.groupBy("error_type").agg(F.min(F.struct((-F.col("k")).alias("k"), "platform")).alias("x")).select("error_type", F.col("x.platform").alias("platform"))
    burst = bursts(own.filter(F.col("occurred_at") >= as_of - days(min(7, n))), ["error_type"]).groupBy("error_type").agg(F.count("*").alias("bursts"))
    shape = cyclical(own, ["error_type"]).select("error_type", "pattern", "strength")
    rows = top.join(shape, "error_type").join(mode, "error_type", "left").join(burst, "error_type", "left")
    return rows.select("error_type", "n", F.coalesce("platform", F.lit("API")).alias("platform"), "pattern", "strength", F.coalesce("bursts", F.lit(0)).alias("bursts"))
