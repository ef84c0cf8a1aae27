"""The queries over tables by day and co-bucketed tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalog import AS_OF, LOGS, OCCURRENCES, since
from faultlens.sources import driver, layout
from faultlens.sources.folders import shared_path

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
LOG_DDL = "id long, occurred_at timestamp_ntz, application_id long, error_type string, platform string, muted boolean"
CHILD_DDL = "error_log_id long, body string"
EDGE_DDL = "parent_error_id long, child_error_id long, frequency long"
KEEP = 10


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return driver.error_logs(spark, d).select("id", "occurred_at", "application_id", "error_type", "platform", "muted")


def _written(spark: SparkSession, d: str) -> str:
    path = shared_path(spark, "daily")
    layout.write_daily(_logs(spark, d), path)
    return path


ENTRIES["a2_partitioned_scan"] = (
    lambda spark, d: layout.since_daily(layout.read_daily(spark, _written(spark, d), LOG_DDL), driver.as_of(), 3, [1, 2]).groupBy("error_type").agg(F.count("*").alias("n"), F.count_distinct("platform").alias("platforms")),
    f"with {LOGS} select error_type, count(*) as n, count(distinct platform) as platforms from logs where {since(3)} and application_id in (1, 2) group by 1",
)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """What retention leaves of errors, their comments (two of each third error) and edges between errors, by day of the error."""
    logs, path = _logs(spark, d), _written(spark, d)
    comments = logs.filter("id % 3 = 0").select(F.col("id").alias("error_log_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("body"))
    edges = logs.filter("id % 5 = 0").select(F.col("id").alias("parent_error_id"), (F.col("id") + 70).alias("child_error_id"), (F.col("id") % 9).alias("frequency"))
    said, linked = shared_path(spark, "daily"), shared_path(spark, "daily")
    layout.write_children(comments, logs, said)
    layout.write_children(edges, logs, linked, "parent_error_id")
    tables = {"error_logs": (path, LOG_DDL, "id"), "comments": (said, CHILD_DDL, "error_log_id"), "edges": (linked, EDGE_DDL, "parent_error_id,child_error_id")}
    layout.retained_daily(spark, tables, driver.AS_OF, KEEP)
    left = [layout.read_daily(spark, at, ddl).groupBy(F.lit(name).alias("name"), F.col(layout.DATE).cast("string").alias("day")).agg(F.count("*").alias("n")) for name, (at, ddl, _) in tables.items()]
    return left[0].union(left[1]).union(left[2])


ENTRIES["i11_partitioned_retention"] = (
    _kept,
    f"""with {LOGS}, gone as (select id from logs where occurred_at < {AS_OF} - interval {KEEP * 24} hour), a as (select id, cast(cast(occurred_at as date) as varchar) as day from logs)
select 'error_logs' as name, day, count(*) as n from a where id not in (select id from gone) group by all
union all select 'comments', day, 2 * count(*) from a where id % 3 = 0 and id not in (select id from gone) group by all
union all select 'edges', day, count(*) from a where id % 5 = 0 and id not in (select id from gone) and id + 70 not in (select id from gone) group by all""",
)


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    occ = driver.occurrences(spark, d)
    errors = occ.select(F.col("error_log_id").alias("id")).distinct()
    comments = occ.filter("id % 4 = 0").select("error_log_id", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("body"), F.col("occurred_at").alias("created_at"))
    tables = layout.bucketed(errors, "id", 8), layout.bucketed(comments, "error_log_id", 8), layout.bucketed(occ.select("error_log_id", "occurred_at"), "error_log_id", 8)
    return layout.eager_loaded(*tables)


ENTRIES["c3_eager_loaded"] = (
    _loaded,
    f"""with {OCCURRENCES}, c as (select error_log_id as id, count(*) as comments, arg_max('c' || user_id, (occurred_at, 'c' || user_id)) as last_comment from occ where id % 4 = 0 group by 1)
select o.id, coalesce(comments, 0) as comments, last_comment, occurrences, last_occurrence from (select error_log_id as id, count(*) as occurrences, max(occurred_at) as last_occurrence from occ group by 1) o left join c using (id)""",
)
