"""Health summaries from JSON columns: breadcrumbs (arrays) and system health (objects)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.numbers import percent, round_half_up
from faultlens.functions.text import sql_fingerprint
from faultlens.operators.windows import since

CRUMB = "array<struct<t:bigint,c:string,m:string,d:string,meta:map<string,string>>>"
POOL = "struct<connection_pool:struct<size:string,busy:string,dead:string,idle:string,waiting:string>,job_queue:map<string,string>>"


def crumbs(logs: DataFrame, as_of: Column, n: int, *categories: str) -> DataFrame:
    """(id, occurred_at, pos, c, m, d, meta) of the given categories. What doesn't parse as an array is skipped."""
    rows = since(logs, as_of, n).filter(F.col("breadcrumbs").startswith("[")).select("id", "occurred_at", F.from_json("breadcrumbs", CRUMB).alias("x"))
    wanted = F.filter("x", lambda e: e["c"].isin(*categories)) if categories else F.col("x")
    each = rows.select("id", "occurred_at", F.posexplode(wanted).alias("pos", "e"))
    return each.select("id", "occurred_at", "pos", "e.c", "e.m", F.expr("try_cast(e.d as double)").alias("d"), "e.meta")


def blank_to(x: Column, name: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(name))


def whole(x: Column) -> Column:
    """The integer that a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(x, F.lit("")), r"^\s*(-?\d+)", 1).try_cast("bigint"), F.lit(0))


def _seen() -> tuple[Column, Column]:
    return F.count_distinct("id").alias("errors"), F.max("occurred_at").alias("last_seen")


def deprecations(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    rows = crumbs(logs, as_of, n, "deprecation").filter("m is not null and trim(m) <> ''")
    return rows.groupBy(F.col("m").alias("message"), blank_to(F.col("meta")["caller"], "Unknown").alias("source")).agg(F.count("*").alias("n"), *_seen())


def repeated_queries(logs: DataFrame, as_of: Column, n: int = 30, threshold: int = 3) -> DataFrame:
    """Per error: fingerprints that occur at least ``threshold`` times."""
    rows = crumbs(logs, as_of, n, "sql").filter("m is not null and m <> ''").withColumn("fingerprint", sql_fingerprint(F.col("m")))
    per = rows.groupBy("id", "occurred_at", "fingerprint").agg(F.count("*").alias("n"), round_half_up(F.sum(F.coalesce("d", F.lit(0.0))), 2).alias("total_ms"), F.min(F.struct("pos", "m")).alias("x"))
    return per.filter(F.col("n") >= threshold).select("id", "occurred_at", "fingerprint", "n", "total_ms", F.col("x.m").alias("sample"))


def repeated_query_summary(logs: DataFrame, as_of: Column, n: int = 30, threshold: int = 3) -> DataFrame:
    per = repeated_queries(logs, as_of, n, threshold)
    return per.groupBy("fingerprint").agg(F.sum("n").alias("n"), F.count("*").alias("errors"), round_half_up(F.sum("total_ms"), 2).alias("total_ms"), F.max("occurred_at").alias("last_seen"))


def cache_health(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Per error: reads, writes, hits and the slowest call; a read that doesn't say hit or miss counts as neither."""
    rows = crumbs(logs, as_of, n, "cache")
    read, hit = F.col("m").startswith("cache read"), F.col("meta")["hit"]
    slowest = F.max(F.when(F.col("d").isNotNull(), F.struct("d", (-F.col("pos")).alias("p"), "m"))).alias("x")
    per = rows.groupBy("id").agg(F.count_if(read).alias("reads"), F.count_if(F.col("m").startswith("cache write")).alias("writes"), F.count_if(read & (hit == "true")).alias("hits"), F.count_if(read & hit.isNotNull() & (hit != "true")).alias("misses"), round_half_up(F.sum(F.coalesce("d", F.lit(0.0))), 1).alias("total_ms"), slowest)
    rate = percent(F.col("hits"), F.col("hits") + F.col("misses"), 1, None)
    return per.select("id", "reads", "writes", "hits", "misses", rate.alias("hit_rate"), "total_ms", F.col("x.m").alias("slowest"), F.col("x.d").alias("slowest_ms"))


def cache_list(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """The health list: worst hit rate first, errors without one last."""
    return cache_health(logs, as_of, n).orderBy(F.col("hit_rate").asc_nulls_last(), "id")


#: The events of a websocket.
CABLE_EVENTS = {"actions": "perform_action", "transmissions": "transmit", "subscriptions": "transmit_subscription_confirmation", "rejections": "transmit_subscription_rejection"}


def cable(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Per channel: its events of four kinds, and all of these."""
    kind = F.col("meta")["event_type"]
    rows = crumbs(logs, as_of, n, "action_cable")
    counts = [F.count_if(kind == event).alias(name) for name, event in CABLE_EVENTS.items()]
    return rows.groupBy(blank_to(F.col("meta")["channel"], "Unknown").alias("channel")).agg(F.count_if(kind.isin(*CABLE_EVENTS.values())).alias("n"), *counts, *_seen())


def storage(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    op = F.col("meta")["operation"]
    took = F.when(F.col("d") > 0, F.col("d"))
    rows = crumbs(logs, as_of, n, "active_storage")
    return rows.groupBy(blank_to(F.col("meta")["service"], "Unknown").alias("service")).agg(F.count("*").alias("n"), F.count_if(op == "upload").alias("uploads"), F.count_if(op.isin("download", "streaming_download")).alias("downloads"), F.count_if(op.isin("delete", "delete_prefixed")).alias("deletes"), F.count_if(op == "exist").alias("exists"), round_half_up(F.avg(took), 2).alias("avg_ms"), F.max(took).alias("max_ms"), *_seen())


def rate_limits(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    m = F.col("meta")
    first = F.min(F.struct("id", "pos", m["type"].alias("type"), m["path"].alias("path"))).alias("x")
    rows = crumbs(logs, as_of, n, "rack_attack")
    given = lambda k: F.when(F.trim(m[k]) != "", m[k])
    return rows.groupBy(blank_to(m["rule"], "unknown").alias("rule")).agg(F.count("*").alias("n"), F.count_distinct(given("discriminator")).alias("discriminators"), F.count_distinct(given("path")).alias("paths"), first, *_seen()).select("rule", "n", "discriminators", "paths", F.col("x.type").alias("match_type"), F.col("x.path").alias("first_path"), "errors", "last_seen")


def _llm_rows(logs: DataFrame, as_of: Column, n: int) -> DataFrame:
    m = F.col("meta")
    number = lambda k: m[k].try_cast("double")
    took = F.coalesce(number("duration_ms"), F.col("d"))
    return crumbs(logs, as_of, n, "llm", "llm_tool").select("id", "occurred_at", "pos", "c", blank_to(m["provider"], "unknown").alias("provider"), blank_to(m["model"], "unknown").alias("model"), m["status"].alias("status"), number("input_tokens").alias("tokens_in"), number("output_tokens").alias("tokens_out"), F.when(took > 0, took).alias("took"), number("cost_usd").alias("cost"), m["error_class"].alias("error_class"))


def _failed() -> Column:
    return F.col("status").isin("error", "timeout")


def llm_health(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """By provider and model: calls, failures, tokens, time and cost."""
    rows = _llm_rows(logs, as_of, n)
    call = F.col("c") == "llm"
    per = rows.groupBy("provider", "model").agg(F.count_if(call).alias("calls"), F.count_if(~call).alias("tool_calls"), F.count_if(_failed()).alias("failed"), F.count("*").alias("attempts"), round_half_up(F.avg("tokens_in"), 0).alias("avg_in"), round_half_up(F.avg("tokens_out"), 0).alias("avg_out"), round_half_up(F.avg("took"), 2).alias("avg_ms"), round_half_up(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost_usd"), *_seen())
    classes = rows.filter(_failed() & F.col("error_class").isNotNull()).groupBy("provider", "model", "error_class").agg(F.count("*").alias("k"))
    top = classes.groupBy("provider", "model").agg(F.min(F.struct((-F.col("k")).alias("k"), "error_class")).alias("x")).select("provider", "model", F.col("x.error_class").alias("top_error"), (-F.col("x.k")).alias("top_error_count"))
    rate = percent(F.col("failed"), F.col("attempts"), 2)
    return per.join(top, ["provider", "model"], "left").withColumn("error_rate", rate).withColumn("severity", F.when(F.col("error_rate") >= 10, "danger").when(F.col("error_rate") >= 5, "warning").otherwise("success"))


def llm_totals(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    rows = _llm_rows(logs, as_of, n)
    one = rows.agg(F.count("*").alias("attempts"), F.count_if(_failed()).alias("failed"), round_half_up(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost_usd"), F.count_distinct("id").alias("errors"), F.count_distinct("provider", "model").alias("models"))
    return one.withColumn("error_rate", percent(F.col("failed"), F.col("attempts"), 2))


def llm_per_error(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Per error; any status but success or none is a failure here, and tools add to the time."""
    rows = _llm_rows(logs, as_of, n)
    bad = F.coalesce("status", F.lit("")).isin("success", "")
    return rows.groupBy("id").agg(F.count_if(F.col("c") == "llm").alias("calls"), F.count_if(F.col("c") == "llm_tool").alias("tool_calls"), F.count_if(~bad).alias("failed"), F.coalesce(F.sum("tokens_in"), F.lit(0.0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0.0)).alias("tokens_out"), F.coalesce(F.sum("took"), F.lit(0.0)).alias("total_ms"), round_half_up(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost_usd"))


def _health(logs: DataFrame, as_of: Column, n: int) -> DataFrame:
    return since(logs, as_of, n).filter(F.col("system_health").startswith("{")).select("id", F.from_json("system_health", POOL).alias("h"))


QUEUE = ("enqueued", "processed", "failed", "dead", "scheduled", "retry", "workers", "ready", "claimed", "blocked", "queued", "errored", "finished")


def job_queues(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """Per error with a queue: the adapter's figures; those it doesn't have are null."""
    rows = _health(logs, as_of, n).filter("h.job_queue['adapter'] is not null")
    return rows.select("id", F.col("h.job_queue")["adapter"].alias("adapter"), *[F.col("h.job_queue")[c].try_cast("bigint").alias(c) for c in QUEUE])


def pools(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    rows = _health(logs, as_of, n).filter("h.connection_pool is not null")
    names = ("size", "busy", "dead", "idle", "waiting")
    each = rows.select("id", *[whole(F.col(f"h.connection_pool.{c}")).alias(c) for c in names])
    return each.withColumn("utilization", percent(F.col("busy"), F.col("size"))).withColumn("stress", F.col("busy") + F.col("dead") + F.col("waiting"))


def last_crumbs(crumb_rows: DataFrame, key: str, order: list[str], keep: int = 40) -> DataFrame:
    """The last ``keep`` rows of each key, numbered in order from 1."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    kept = crumb_rows.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= keep).drop("_back")
    return kept.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


#: The measures of each page's head, as columns of ``page_totals``.
PAGES = {
    "deprecation": ("unique", "total", "affected"),
    "rack_attack": ("unique", "total"),
    "action_cable": ("unique", "total", "rejections"),
    "active_storage": ("unique", "total", "group_errors"),
    "unique_ips": ("unique",),
    "repeated_queries": ("unique", "total", "affected"),
    "cache": ("errors", "avg_hit_rate", "total"),
}


def page_totals(logs: DataFrame, as_of: Column, n: int = 30, threshold: int = 3) -> DataFrame:
    """(page, measure, value): the figures at the head of the health pages that read breadcrumbs, over all their rows.

    Crumbs are read once: each becomes a row of the pages that count it, and rows of a page, group and error are counted before pages are.
    """
    rows = crumbs(logs, as_of, n, "deprecation", "rack_attack", "action_cable", "active_storage", "sql", "cache")
    c, text, m = F.col("c"), F.col("m"), F.col("meta")
    of = lambda page, group: F.struct(F.lit(page).alias("page"), group.alias("g"))
    own = (
        F.when((c == "deprecation") & (F.trim(text) != ""), of("deprecation", F.concat_ws("\n", "m", blank_to(m["caller"], "Unknown"))))
        .when(c == "rack_attack", of("rack_attack", blank_to(m["rule"], "unknown")))
        .when(c == "action_cable", of("action_cable", blank_to(m["channel"], "Unknown")))
        .when(c == "active_storage", of("active_storage", blank_to(m["service"], "Unknown")))
        .when((c == "sql") & (text != ""), of("repeated_queries", sql_fingerprint(text)))
        .when(c == "cache", of("cache", F.lit("")))
    )
    ips = F.when((c == "rack_attack") & (F.trim(m["discriminator"]) != ""), of("unique_ips", m["discriminator"]))
    each = rows.select("id", "occurred_at", "c", "m", "meta", F.explode(F.array_compact(F.array(own, ips))).alias("x")).select("*", "x.page", "x.g")
    read, hit = text.startswith("cache read"), m["hit"]
    counted = F.when(c == "action_cable", m["event_type"].isin(*CABLE_EVENTS.values())).when(c == "cache", read | text.startswith("cache write")).otherwise(True)
    at = F.when(F.col("page") == "repeated_queries", F.col("occurred_at"))
    per = each.groupBy("id", "page", "g", at.alias("at")).agg(F.count_if(counted).alias("k"), F.count_if((c == "action_cable") & (m["event_type"] == CABLE_EVENTS["rejections"])).alias("rejected"), F.count_if((c == "cache") & read & (hit == "true")).alias("hits"), F.count_if((c == "cache") & read & (hit != "true")).alias("misses"))
    few = per.filter((F.col("page") != "repeated_queries") | (F.col("k") >= threshold)).select("page", "g", "id", "k", "rejected", percent(F.col("hits"), F.col("hits") + F.col("misses"), 1, None).alias("rate"), F.lit(True).alias("real"))
    # these pages have figures without any crumb too
    always = logs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in ("unique_ips", "repeated_queries", "cache")])).alias("page"), F.lit(False).alias("real"))
    affected = F.when(F.col("page").isin("deprecation", "repeated_queries"), F.col("id"))
    pages = few.unionByName(always, allowMissingColumns=True).groupBy("page").agg(F.count_distinct("g").alias("unique"), F.sum("k").alias("total"), F.count_distinct(affected).alias("affected"), F.sum("rejected").alias("rejections"), F.count_if("real").alias("group_errors"), F.count_if("real").alias("errors"), round_half_up(F.avg("rate"), 1).alias("avg_hit_rate"))
    value = F.explode(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("double").alias("value")) for x in pages.columns[1:]])).alias("x")
    wanted = " or ".join(f"(page = '{k}' and measure in ({', '.join(map(repr, v))}))" for k, v in PAGES.items())
    listed = pages.select("page", value).select("page", "x.*").filter(wanted)
    is_ips = F.col("page") == "unique_ips"
    return listed.select(F.when(is_ips, "rack_attack").otherwise(F.col("page")).alias("page"), F.when(is_ips, "unique_ips").otherwise(F.col("measure")).alias("measure"), "value")


def health_totals(logs: DataFrame, as_of: Column, n: int = 30) -> DataFrame:
    """(page, measure, value): the same for the pages that read the system's health."""
    queues = job_queues(logs, as_of, n).agg(F.count("*").alias("errors"), F.sum(F.coalesce("failed", "errored", F.lit(0))).alias("failed"), F.count_distinct("adapter").alias("adapters"))
    pool = pools(logs, as_of, n).agg(F.count("*").alias("errors"), F.coalesce(F.max("utilization"), F.lit(0.0)).alias("max_utilization"), F.sum("dead").alias("dead"), F.sum("waiting").alias("waiting"))
    return _measures(queues, "job_queues").unionByName(_measures(pool, "pools"))


def _measures(one: DataFrame, page: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("x")
    return one.select(F.lit(page).alias("page"), each).select("page", "x.*")
