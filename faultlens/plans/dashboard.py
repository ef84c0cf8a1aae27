"""Dashboard figures: one pass for all counts, small aggregates for series and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.numbers import change, ladder, percent, round_half_up, seconds, spike_severity
from faultlens.functions.severity import severity
from faultlens.functions.text import truncate
from faultlens.operators.sequences import anomalies
from faultlens.operators.windows import day_spine, day_start, days, since


def counts(logs: DataFrame, as_of: Column) -> DataFrame:
    """All scalar figures; the users of two days in a scan of these days only, as counting them among all rows would expand each row."""
    at, today, yesterday = F.col("occurred_at"), day_start(as_of), day_start(as_of, 1)
    is_today, is_yesterday = at >= today, (at >= yesterday) & (at < today)
    took = F.when(F.col("resolved") & (F.col("resolved_at") >= as_of - days(30)), seconds(F.col("occurred_at"), F.col("resolved_at")) / 3600)
    one = logs.agg(
        F.count_if(is_today).alias("total_today"),
        F.count_if(is_yesterday).alias("total_yesterday"),
        F.count_if(at >= as_of - days(7)).alias("total_week"),
        F.count_if(at >= as_of - days(30)).alias("total_month"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if(F.col("resolved")).alias("resolved"),
        F.count_if(F.col("reopened_at").isNotNull()).alias("reopened"),
        F.avg(took).alias("hours"),
    )
    recent = logs.filter(at >= yesterday).groupBy("user_id").agg(F.bool_or(is_today).alias("today"), F.bool_or(is_yesterday).alias("yesterday")).filter("user_id is not null")
    one = one.join(F.broadcast(recent.agg(F.count_if("today").alias("users_today"), F.count_if("yesterday").alias("users_yesterday"))))
    hours_today = F.greatest(round_half_up(seconds(today, as_of) / 3600, 1), F.lit(1.0))
    trend = change(F.col("total_today"), F.col("total_yesterday"))
    return one.select(
        *[c for c in one.columns if c != "hours"],
        (F.col("users_today") - F.col("users_yesterday")).alias("users_change"),
        F.least(round_half_up(F.col("total_today") / hours_today, 1), F.lit(100.0)).alias("error_rate"),
        trend.alias("trend_percentage"),
        F.when(trend > 10, "increasing").when(trend < -10, "decreasing").otherwise("stable").alias("trend_direction"),
        round_half_up(F.col("hours"), 2).alias("avg_resolution_hours"),
    )


def by_platform(logs: DataFrame) -> DataFrame:
    """The group without a platform stays."""
    return logs.groupBy("platform").agg(F.count("*").alias("n"))


def top_types(logs: DataFrame, as_of: Column, n: int = 7, k: int = 10) -> DataFrame:
    top = since(logs, as_of, n).groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "error_type").limit(k)
    return top.withColumn("severity", severity(F.col("error_type")))


def daily_trend(logs: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    """A row for each date from n days ago to today, zero where nothing occurred."""
    counted = logs.filter(F.col("occurred_at") >= day_start(as_of, n)).filter(F.col("occurred_at") >= as_of - days(n)).groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))
    return day_spine(logs, as_of - days(n), as_of).join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def severity_histogram(logs: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    level = severity(F.col("error_type"))
    return since(logs, as_of, n).agg(*[F.count_if(level == x).alias(x) for x in ("critical", "high", "medium", "low")])


def spike(logs: DataFrame, as_of: Column, baselines: DataFrame | None = None) -> DataFrame:
    """Today against the mean of the week's trend, which spans eight dates and is divided by seven.

    With ``baselines``, a type and platform that is anomalous today is a spike too, and the worst one is told.
    """
    today = F.col("occurred_at") >= day_start(as_of)
    one = since(logs, as_of, 7).agg(F.count_if(today).alias("today"), F.count("*").alias("week"))
    mean = F.col("week") / 7.0
    average = round_half_up(mean, 1)
    times = F.when(average > 0, F.col("today") / F.when(average > 0, average).otherwise(1.0)).otherwise(0.0)
    doubled = (mean > 0) & (F.col("today") >= 2 * mean)
    columns = ["today", average.alias("average"), round_half_up(times, 1).alias("multiplier")]
    if baselines is None:
        return one.select(*columns, doubled.alias("spike"), spike_severity(times).alias("severity"))
    odd = anomalies(logs, baselines, as_of).filter("level is not null")
    worst = odd.agg(F.min(F.struct((-F.coalesce("deviations", F.lit(0.0))).alias("least"), "error_type", "platform", "level", "deviations")).alias("w"))
    rows = one.crossJoin(worst)  # a row each
    found = F.col("w").isNotNull()
    return rows.select(*columns, (found | doubled).alias("spike"), spike_severity(times).alias("severity"), found.alias("baseline_detected"), F.col("w.error_type").alias("anomaly_error_type"), F.col("w.platform").alias("anomaly_platform"), F.col("w.level").alias("anomaly_level"), round_half_up(F.col("w.deviations"), 1).alias("std_devs_above"))


def top_by_impact(logs: DataFrame, as_of: Column, n: int = 7, k: int = 6) -> DataFrame:
    """Distinct users of a row, which are none or one, times its occurrences."""
    impact = F.when(F.col("user_id").isNotNull(), F.col("occurrence_count")).otherwise(0).cast("bigint")
    return since(logs, as_of, n).select("id", "error_type", truncate(F.col("message"), 80).alias("message"), F.when(F.col("user_id").isNotNull(), 1).otherwise(0).alias("users"), impact.alias("impact")).orderBy(F.col("impact").desc(), "id").limit(k)


def daily_series(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Counts by day; gaps between the first and the last are filled."""
    counted = since(logs, as_of, n).groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))
    span = counted.agg(F.min("day").alias("a"), F.max("day").alias("z")).filter("a is not null")
    spine = span.select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("day"))
    return spine.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def by_hour(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    counted = since(logs, as_of, n).groupBy(F.hour("occurred_at").alias("hour")).agg(F.count("*").alias("n"))
    return logs.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def with_email(users: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """A name for each user_id: the account's e-mail, else a made-up one."""
    named = users.join(accounts, "user_id", "left") if accounts is not None else users.withColumn("email", F.lit(None).cast("string"))
    return named.withColumn("email", F.coalesce("email", F.concat(F.lit("User #"), F.col("user_id").cast("string"))))


def top_users(logs: DataFrame, as_of: Column, accounts: DataFrame | None = None, n: int = 30, k: int = 10) -> DataFrame:
    top = since(logs, as_of, n).filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(k)
    return with_email(top, accounts).select("user_id", "email", "n")


def resolution(logs: DataFrame, as_of: Column, n: int = 30, application: int | None = None, compat_unscoped: bool = True) -> DataFrame:
    """Resolution rate, and mobile and API counts. As the original does, the numerator ignores the application unless ``compat_unscoped`` is off."""
    mine = F.lit(True) if application is None else F.col("application_id") == application
    one = since(logs, as_of, n).agg(
        F.count_if(mine).alias("total"),
        F.count_if(F.col("resolved") & (F.lit(True) if compat_unscoped else mine)).alias("done"),
        F.count_if(mine & F.col("platform").isin("iOS", "Android")).alias("mobile_errors"),
        F.count_if(mine & (F.col("platform").isNull() | (F.col("platform") == "API"))).alias("api_errors"),
    )
    return one.select("total", percent(F.col("done"), F.col("total")).alias("resolution_rate"), "mobile_errors", "api_errors")


def statistics(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Totals by day, with how many are unresolved."""
    return since(logs, as_of, n).groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("unresolved"))


def health_status(score: Column, unresolved: Column) -> Column:
    return ladder(score, [(80, "healthy"), (60, "warning")], "critical") if unresolved is None else F.when((score >= 80) & (unresolved <= 10), "healthy").when((score >= 60) & (unresolved <= 50), "warning").otherwise("critical")
