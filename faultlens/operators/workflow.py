"""Changes of the workflow as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.filters import can_transition
from faultlens.operators.windows import days


def _set(logs: DataFrame, where: Column, **values: Column) -> DataFrame:
    where = F.coalesce(where, F.lit(False))
    return logs.withColumns({k: F.when(where, v).otherwise(F.col(k)) if k in logs.columns else F.when(where, v) for k, v in values.items()})


def ids(wanted: list[int]) -> Column:
    return F.col("id").isin(list(wanted))


def resolve(logs: DataFrame, where: Column, as_of: Column, by: str | None = None, comment: str | None = None) -> DataFrame:
    return _set(logs, where, resolved=F.lit(True), status=F.lit("resolved"), resolved_at=as_of, resolved_by_name=F.lit(by).cast("string"), resolution_comment=F.lit(comment).cast("string"))


def assign(logs: DataFrame, where: Column, to: str, as_of: Column) -> DataFrame:
    return _set(logs, where, assigned_to=F.lit(to), assigned_at=as_of, status=F.lit("in_progress"))


def unassign(logs: DataFrame, where: Column) -> DataFrame:
    return _set(logs, where, assigned_to=F.lit(None).cast("string"), assigned_at=F.lit(None).cast("timestamp_ntz"))


def set_priority(logs: DataFrame, where: Column, level: int) -> DataFrame:
    return _set(logs, where, priority_level=F.lit(level))


def snooze(logs: DataFrame, where: Column, hours: float, as_of: Column) -> DataFrame:
    return _set(logs, where, snoozed_until=as_of + days(hours / 24))


def unsnooze(logs: DataFrame, where: Column) -> DataFrame:
    return _set(logs, where, snoozed_until=F.lit(None).cast("timestamp_ntz"))


def mute(logs: DataFrame, where: Column, as_of: Column, by: str | None = None, reason: str | None = None) -> DataFrame:
    return _set(logs, where, muted=F.lit(True), muted_at=as_of, muted_by=F.lit(by).cast("string"), muted_reason=F.lit(reason).cast("string"))


def unmute(logs: DataFrame, where: Column) -> DataFrame:
    none = F.lit(None)
    return _set(logs, where, muted=F.lit(False), muted_at=none.cast("timestamp_ntz"), muted_by=none.cast("string"), muted_reason=none.cast("string"))


def set_status(logs: DataFrame, where: Column, to: str) -> DataFrame:
    """Only where the transition is allowed; resolved follows the status."""
    return _set(logs, where & can_transition(F.col("status"), to), status=F.lit(to), resolved=F.lit(to == "resolved"))


def comments(logs: DataFrame, where: Column, author: str, body: str, as_of: Column) -> DataFrame:
    """The rows to append to error_comments; bodies have at most 10 000 characters."""
    return logs.filter(where).select(F.col("id").alias("error_log_id"), F.lit(author[:255]).alias("author_name"), F.lit(body[:10_000]).alias("body"), as_of.alias("created_at"))


def delete(logs: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the ids of another table."""
    return logs.join(gone.select("id"), "id", "left_anti")


def retained(logs: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], as_of: Column, n: int = 90, of: str = "occurred_at") -> dict[str, DataFrame]:
    """Tables without errors older than n days (by ``of``) and what refers to them. ``children``: name -> (table, columns with error ids)."""
    old = logs.filter(F.col(of) < as_of - days(n)).select("id")
    out = {"error_logs": logs.filter(F.col(of).isNull() | (F.col(of) >= as_of - days(n)))}
    for name, (table, columns) in children.items():
        for c in columns:
            table = table.join(old.withColumnRenamed("id", c), c, "left_anti")
        out[name] = table
    return out


def backfilled_status(logs: DataFrame) -> DataFrame:
    return _set(logs, F.col("resolved") & (F.col("status") != "resolved"), status=F.lit("resolved"))


def with_applications(apps: DataFrame, names: DataFrame) -> DataFrame:
    """Applications with those of ``names`` (name) that are missing; their ids are null until the sink gives them."""
    return apps.unionByName(names.select("name").distinct().join(apps, "name", "left_anti"), allowMissingColumns=True)


def batch_counts(logs: DataFrame, wanted: list[int]) -> DataFrame:
    """(asked, found, missing) of a batch action's ids; repeats count once."""
    distinct = len(set(wanted))
    return logs.filter(ids(wanted)).agg(F.lit(distinct).cast("long").alias("asked"), F.count_distinct("id").alias("found")).withColumn("missing", F.col("asked") - F.col("found"))


def added_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hourly counts of swallowed exceptions after a flush: a known place's counts grow, an unknown one is added.

    Both: exception_class, raise_location, rescue_location (null for raises), period_hour, application_id, raise_count,
    rescue_count, last_seen_at. Names are cut to 250 characters; rows without a class or a place are left out.
    """
    names = ["exception_class", "raise_location", "rescue_location"]
    keys = [*names, "period_hour", "application_id"]
    columns = [*keys, "raise_count", "rescue_count", "last_seen_at"]
    cut = new.select(columns).withColumns({c: F.substring(c, 1, 250) for c in names}).withColumn("rescue_location", F.nullif("rescue_location", F.lit("")))
    named = cut.filter("trim(exception_class) <> '' and trim(raise_location) <> ''")
    both = old.select(columns).unionByName(named)
    return both.groupBy(*keys).agg(F.sum(F.coalesce("raise_count", F.lit(0))).alias("raise_count"), F.sum(F.coalesce("rescue_count", F.lit(0))).alias("rescue_count"), F.max("last_seen_at").alias("last_seen_at"))
