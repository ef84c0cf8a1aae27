"""Releases, resolution times, recurring issues, reach, swallowed exceptions and the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.numbers import change, percent, ratio, round_half_up, seconds
from faultlens.functions.severity import severity
from faultlens.functions.text import truncate
from faultlens.operators.windows import days, since

def _hours() -> Column:
    return seconds(F.col("occurred_at"), F.col("resolved_at")) / 3600


def _urgent() -> Column:
    return severity(F.col("error_type")).isin("critical", "high")


def release_timeline(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Versions by first sight: counts, the step from the one before, errors first seen in it, stability."""
    rows = since(logs, as_of, n).filter("app_version is not null and app_version <> ''")
    per = rows.groupBy("app_version").agg(F.count("*").alias("n"), F.count_distinct("error_type").alias("types"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.array_join(F.array_sort(F.collect_set(F.nullif("git_sha", F.lit("")))), ",").alias("shas"))
    new = rows.filter("error_hash is not null").groupBy("error_hash").agg(F.min(F.struct("occurred_at", "id", "app_version")).alias("x")).groupBy(F.col("x.app_version").alias("app_version")).agg(F.count("*").alias("new_errors"))
    # as many rows as there are versions
    order, all_ = Window.partitionBy(F.lit(1)).orderBy("first_seen", "app_version"), Window.partitionBy(F.lit(1))
    before, mean = F.lag("n").over(order), F.avg("n").over(all_)
    out = per.join(new, "app_version", "left").select(
        "app_version", "n", "types", "first_seen", "last_seen", "shas",
        F.coalesce("new_errors", F.lit(0)).alias("new_errors"),
        (F.col("n") - before).alias("delta"),
        F.when(before > 0, round_half_up((F.col("n") - before) * 100.0 / before, 1)).alias("delta_percentage"),
        F.when(F.col("n") <= mean, "green").when(F.col("n") <= 2 * mean, "yellow").otherwise("red").alias("stability"),
        (F.col("n") > 2 * mean).alias("problematic"),
        F.lead("n").over(order).isNull().alias("current"),
    )
    return out


def release_summary(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    t = release_timeline(logs, as_of, n)
    return t.agg(F.count("*").alias("releases"), F.max(F.when(F.col("current"), F.col("app_version"))).alias("current_version"), round_half_up(F.avg("n"), 1).alias("average"))


def release_comparison(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """The version seen last against the one before it."""
    per = since(logs, as_of, n).filter("app_version is not null and app_version <> ''").groupBy("app_version").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_seen")).orderBy(F.col("last_seen").desc(), "app_version").limit(2)
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("last_seen").desc(), "app_version"))
    one = per.withColumn("at", at).agg(*[F.max(F.when(F.col("at") == i, F.col(c))).alias(f"{c}_{name}") for i, name in ((1, "now"), (2, "before")) for c in ("app_version", "n")])
    return one.withColumn("change_percentage", F.when(F.col("n_before") > 0, change(F.col("n_now"), F.col("n_before"))))


def mttr(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    done = since(logs, as_of, n).filter("resolved and resolved_at is not null")
    minutes = seconds(F.col("occurred_at"), F.col("resolved_at")) / 60
    return done.agg(F.count("*").alias("resolved"), F.coalesce(round_half_up(F.avg(round_half_up(_hours(), 2)), 2), F.lit(0.0)).alias("mttr_hours"), F.floor(F.min(minutes)).alias("fastest_minutes"), round_half_up(F.max(minutes) / 60, 1).alias("slowest_hours"))


def mttr_by(logs: DataFrame, as_of: Column, key: str, n: int = 30) -> DataFrame:
    """By platform or severity; groups without resolved rows are absent."""
    done = since(logs, as_of, n).filter("resolved and resolved_at is not null")
    group = severity(F.col("error_type")) if key == "severity" else F.col(key)
    return done.groupBy(group.alias(key)).agg(round_half_up(F.avg(_hours()), 2).alias("mttr_hours")).filter(F.col(key).isNotNull())


def mttr_by_week(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Seven-day buckets from the first day of the window; empty ones are absent."""
    start = as_of - days(n)
    week = F.floor(seconds(start, F.col("occurred_at")) / 604800)
    done = since(logs, as_of, n).filter("resolved and resolved_at is not null")
    return done.groupBy(week.alias("week")).agg(F.count("*").alias("n"), round_half_up(F.avg(_hours()), 2).alias("mttr_hours"))


def high_frequency(logs: DataFrame, as_of: Column, n: int = 30, k: int = 10) -> DataFrame:
    per = since(logs, as_of, n).filter("occurrence_count > 10").groupBy("error_type").agg(F.sum("occurrence_count").alias("occurrences"), F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"), F.count("*").alias("n"))
    top = per.orderBy(F.col("occurrences").desc(), "error_type").limit(k)
    return top.withColumn("duration_days", round_half_up(seconds(F.col("first_seen"), F.col("last_seen")) / 86400, 0)).withColumn("still_active", F.col("last_seen") > as_of - days(1))


def persistent(logs: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    rows = logs.filter(~F.col("resolved") & (F.col("first_seen_at") < as_of - days(7))).orderBy("first_seen_at", "id").limit(k)
    return rows.select("id", "error_type", "first_seen_at", round_half_up(seconds(F.col("first_seen_at"), as_of) / 86400, 0).alias("age_days"))


def user_impact(logs: DataFrame, as_of: Column, n: int = 30, total_users: int | None = None) -> DataFrame:
    latest = F.max(F.struct("occurred_at", "id", "message")).alias("x")
    per = since(logs, as_of, n).groupBy("error_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"), latest).filter("users > 0")
    share = F.lit(None).cast("double") if not total_users else round_half_up(F.col("users") * 100.0 / total_users, 1)
    return per.select("error_type", "users", "n", F.col("x.id").alias("latest_id"), truncate(F.col("x.message"), 120).alias("message"), severity(F.col("error_type")).alias("severity"), share.alias("impact"))


def user_impact_of_all(logs: DataFrame, accounts: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Each type's users and their share of all accounts, which are counted as no total is configured. Null without accounts."""
    per = since(logs, as_of, n).groupBy("error_type").agg(F.count_distinct("user_id").alias("users")).filter("users > 0")
    total = accounts.agg(F.count("*").alias("total_users"))
    return per.join(F.broadcast(total)).withColumn("impact", F.when(F.col("total_users") > 0, round_half_up(F.col("users") * 100.0 / F.col("total_users"), 1)))


def user_impact_summary(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Users are counted once for each type."""
    per = user_impact(logs, as_of, n)
    return per.agg(F.count("*").alias("types"), F.sum("users").alias("users"), F.min(F.struct((-F.col("users")).alias("u"), "error_type")).alias("x")).select("types", "users", F.col("x.error_type").alias("most_impactful"))


def swallowed(counters: DataFrame, as_of: Column, n: int = 30, threshold: float = 0.95) -> DataFrame:
    """Exceptions that are nearly always rescued where they are raised."""
    recent = counters.filter(F.col("period_hour") >= F.date_trunc("HOUR", as_of - days(n)).cast("timestamp_ntz"))
    per = recent.groupBy("exception_class", "raise_location").agg(F.sum("raise_count").alias("raised"), F.sum("rescue_count").alias("rescued"), F.max("last_seen_at").alias("last_seen"), F.max("rescue_location").alias("rescue_location"))
    return per.withColumn("ratio", F.coalesce(round_half_up(ratio(F.col("rescued"), F.col("raised")), 4), F.lit(0.0))).filter(F.col("ratio") >= threshold)


def digest(logs: DataFrame, as_of: Column, n: int = 1) -> DataFrame:
    """Counts of the period and of the one before it, in one scan."""
    at = F.col("occurred_at")
    now = at >= as_of - days(n)
    before = (at >= as_of - days(2 * n)) & ~now
    done = F.col("resolved")
    one = logs.filter(at >= as_of - days(2 * n)).agg(F.count_if(now & (F.col("occurrence_count") <= 1)).alias("new_errors"), F.count_if(now).alias("total"), F.coalesce(F.sum(F.when(now, F.col("occurrence_count"))), F.lit(0)).alias("occurrences"), F.count_if(now & done).alias("resolved"), F.count_if(now & ~done).alias("unresolved"), F.count_if(now & _urgent()).alias("urgent"), F.count_if(before).alias("previous"))
    return one.select("*", percent(F.col("resolved"), F.col("total")).alias("resolution_rate"), F.when(F.col("previous") > 0, change(F.col("total"), F.col("previous"))).alias("change_percentage"))


def digest_top(logs: DataFrame, as_of: Column, n: int = 1, k: int = 5) -> DataFrame:
    per = since(logs, as_of, n).filter(~F.col("resolved")).groupBy("error_type").agg(F.count("*").alias("n"), F.max(F.struct("occurred_at", "id")).alias("x"))
    return per.orderBy(F.col("n").desc(), "error_type").limit(k).select("error_type", "n", F.col("x.id").alias("sample_id"))


def digest_urgent(logs: DataFrame, as_of: Column, n: int = 1, k: int = 5) -> DataFrame:
    return since(logs, as_of, n).filter(~F.col("resolved") & _urgent()).orderBy(F.col("occurred_at").desc(), "id").limit(k).select("id", "error_type", "occurred_at")


def digest_lines(logs: DataFrame, as_of: Column, n: int = 1, k: int = 5) -> DataFrame:
    """(section, place, line): the lists of a digest mail, with their lines as text."""
    message = logs.select(F.col("id").alias("sample_id"), "message")
    top = digest_top(logs, as_of, n, k).join(message, "sample_id")
    urgent = since(logs, as_of, n).filter(~F.col("resolved") & _urgent()).orderBy(F.col("occurred_at").desc(), "id").limit(k)
    place = lambda *order: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long").alias("place")  # noqa: E731  # k rows
    first = urgent.select(F.lit("urgent").alias("section"), place(F.col("occurred_at").desc(), "id"), F.concat(F.lit("["), F.upper(severity(F.col("error_type"))), F.lit("] "), "error_type", F.lit(": "), "message").alias("line"))
    second = top.select(F.lit("top").alias("section"), place(F.col("n").desc(), "error_type"), F.concat("error_type", F.lit(" ("), F.col("n").cast("string"), F.lit("x): "), "message").alias("line"))
    return first.unionByName(second)


def filter_options(logs: DataFrame) -> DataFrame:
    """Distinct values that a list can be filtered by."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("error_type", "platform", "assigned_to")])).alias("v")
    return logs.select(values).select("v.name", "v.value").filter("value is not null").distinct()


def applications(apps: DataFrame, logs: DataFrame) -> DataFrame:
    """Every application with its totals, also those without errors."""
    per = logs.groupBy("application_id").agg(F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("open"))
    return apps.join(per, apps.id == per.application_id, "left").select("name", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("open", F.lit(0)).alias("unresolved"))


def application_stats(logs: DataFrame, as_of: Column) -> DataFrame:
    at = F.col("occurred_at")
    return logs.groupBy("application_id").agg(F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if(at >= as_of - days(1)).alias("day"), F.count_if(at >= as_of - days(7)).alias("week"), F.count_if(at >= as_of - days(30)).alias("month"))
