"""The error tables as views of the driver's star schema, by integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Three classes for each event type, in the order of k modulo 3.
TYPES = {
    "error": ["SecurityError", "NoMethodError", "Timeout::Error"],
    "click": ["ArgumentError", "CustomClickError", "JSON::ParserError"],
    "view": ["ActionView::MissingTemplate", "LoadError", "KeyError"],
    "purchase": ["PaymentDeclined", "ActiveRecord::RecordInvalid", "Redis::ConnectionError"],
    "signup": ["ActiveRecord::RecordNotUnique", "TypeError", "SignupRejected"],
}
AS_OF = "2024-01-30 23:59:59"


def as_of() -> object:
    return F.lit(AS_OF).cast("timestamp_ntz")


def error_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, with the columns of an error group."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    user, event, ts = F.col("user_id"), F.col("event_id"), F.col("ts")
    names = F.create_map(*[F.lit(x) for t, v in TYPES.items() for x in (t, v)])
    error_type = F.element_at(F.element_at(names, F.col("event_type")), k % 3 + 1)
    hours = lambda n: F.make_dt_interval(F.lit(0), n)
    resolved = k % 3 == 0
    day = F.dayofmonth("ts")
    return e.select(
        event.alias("id"),
        ts.alias("occurred_at"),
        (user % 3 + 1).alias("application_id"),
        error_type.alias("error_type"),
        F.when(k % 5 == 0, "iOS").when(k % 5 == 1, "Android").when(k % 5 == 2, "API").when(k % 5 == 3, "Web").alias("platform"),
        F.when(k % 10 != 0, user).alias("user_id"),
        (1 + (k % 40) * (event % 4)).cast("int").alias("occurrence_count"),
        resolved.alias("resolved"),
        F.when(resolved, ts + F.make_dt_interval(F.lit(0), F.lit(0), (1 + k) * 37)).alias("resolved_at"),
        F.when(k == 98, F.lit(None)).when(k == 99, "").otherwise(F.concat(F.lit("1."), F.floor(day / 5).cast("string"), F.lit(".0"))).alias("app_version"),
        F.when(k != 97, F.concat(F.lit("sha"), (day % 7).cast("string"))).alias("git_sha"),
        F.concat(error_type, F.lit("-"), (user % 20).cast("string")).alias("error_hash"),
        F.when(resolved, "resolved").when(k % 4 == 0, "new").when(k % 4 == 1, "in_progress").when(k % 4 == 2, "investigating").otherwise("wont_fix").alias("status"),
        F.when(event % 5 == 0, F.concat(F.lit("dev"), (user % 3).cast("string"))).alias("assigned_to"),
        F.when(event % 7 == 0, ts + hours(F.lit(240))).alias("snoozed_until"),
        (event % 11 == 0).alias("muted"),
        F.when(k % 13 == 0, ts + hours(F.lit(1))).alias("reopened_at"),
        (event % 5).cast("int").alias("priority_level"),
        (ts - hours(k * 4)).alias("first_seen_at"),
        (ts + hours(k % 50)).alias("last_seen_at"),
        F.concat(error_type, F.lit(" for user "), user.cast("string"), F.lit(" at 0x"), F.lower(F.hex(event)), F.lit(" id: "), k.cast("string")).alias("message"),
        k.alias("k"),
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw occurrences: events of 20 error ids (event type and user modulo 4)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type"))
    return e.select(F.col("event_id").alias("id"), (kind * 10 + F.col("user_id") % 4).alias("error_log_id"), F.col("ts").alias("occurred_at"), "user_id", F.concat(F.lit("r"), (F.col("event_id") % 50).cast("string")).alias("request_id"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("session_id"))


CRUMB = "array<struct<t:bigint,c:string,m:string,d:string,meta:map<string,string>>>"


def breadcrumb_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, occurred_at, breadcrumbs JSON): one error per order; its crumbs are the order's lines, which are dealt by order once."""
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "x.*")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    q, part, supp = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_suppkey")
    kind = part % 8
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    pick = lambda *xs: F.element_at(F.array(*xs), kind.cast("int") + 1)
    category = pick(*[F.lit(x) for x in ("sql", "sql", "cache", "deprecation", "rack_attack", "action_cable", "active_storage", "llm")])
    message = pick(
        text("SELECT * FROM parts WHERE id = ", part % 7, " AND name = 'n", supp, "'"),
        text("SELECT * FROM suppliers WHERE id IN (", supp, ", ", part, ")"),
        F.when(q % 3 == 0, text("cache write: k", part % 5)).otherwise(text("cache read: k", part % 5)),
        F.when(q % 9 == 0, F.lit("")).otherwise(text("old call ", part % 6)),
        text("throttle ", supp % 4),
        F.lit("cable"),
        F.lit("storage"),
        text("chat ", part % 3),
    )
    none = F.lit(None).cast("string")
    pairs = lambda **kw: F.map_filter(F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    meta = pick(
        pairs(x=none),
        pairs(x=none),
        pairs(hit=F.when(q % 3 == 1, F.lit("true")).when(q % 3 == 2, F.lit("false"))),
        pairs(caller=F.when(q % 2 == 0, text("file", supp % 3, ".rb"))),
        pairs(rule=text("rule", supp % 4), type=F.when(q % 2 == 0, F.lit("throttle")).otherwise(F.lit("blocklist")), discriminator=text("ip", part % 9), path=text("/p", q % 4)),
        pairs(channel=F.when(q % 5 != 0, text("Room", supp % 3)), event_type=F.element_at(F.array(*[F.lit(x) for x in ("perform_action", "transmit", "transmit_subscription_confirmation", "transmit_subscription_rejection")]), q % 4 + 1)),
        pairs(service=F.when(q % 6 != 0, text("S", supp % 2)), operation=F.element_at(F.array(*[F.lit(x) for x in ("upload", "download", "streaming_download", "delete", "delete_prefixed", "exist")]), q % 6 + 1)),
        pairs(provider=text("p", part % 2), model=F.element_at(F.array(F.lit("gpt-4o"), F.lit("o1-mini"), F.lit("none")), (part % 3).cast("int") + 1), status=F.element_at(F.array(F.lit("success"), F.lit("success"), F.lit("error"), F.lit("timeout")), q % 4 + 1), input_tokens=F.when(q % 7 != 0, part * 3), output_tokens=q * 5, duration_ms=q * 11, cost_usd=F.when(q % 2 == 0, text("0.00", q)), error_class=F.when(q % 4 >= 2, text("E", supp % 2))),
    )
    crumb = F.struct((F.col("l_linenumber") * 1000).cast("bigint").alias("t"), category.alias("c"), message.alias("m"), F.when(q % 4 != 0, q.cast("string")).alias("d"), meta.alias("meta"))
    each = lines.select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("pos"), F.to_json(crumb).alias("json")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["json"]), ",")
    crumbs = each.groupBy("id").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("breadcrumbs"))
    # every 50th is malformed
    broken = crumbs.withColumn("breadcrumbs", F.when(F.col("id") % 50 == 7, "{not json").otherwise(F.col("breadcrumbs")))
    return orders.join(broken, F.col("o_orderkey") == F.col("id")).select("id", F.col("o_orderdate").alias("occurred_at"), "breadcrumbs")


def health_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, occurred_at, system_health JSON): pool and queue figures of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, i = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    pool = F.struct((5 + k % 5).alias("size"), (k % 5).alias("busy"), (i % 3).alias("dead"), (k % 4).alias("idle"), (i % 6).alias("waiting"))
    side = F.struct(F.lit("sidekiq").alias("adapter"), (k * 2).alias("enqueued"), (k * 10).alias("processed"), (i % 17).alias("failed"), (i % 4).alias("dead"), (k % 9).alias("scheduled"), (k % 3).alias("retry"), F.lit(4).alias("workers"))
    solid = F.struct(F.lit("solid_queue").alias("adapter"), (k % 8).alias("ready"), (k % 6).alias("scheduled"), (i % 5).alias("claimed"), (i % 13).alias("failed"), (i % 2).alias("blocked"))
    good = F.struct(F.lit("good_job").alias("adapter"), (k % 12).alias("queued"), (i % 7).alias("errored"), (k * 3).alias("finished"))
    wrap = lambda queue: F.to_json(F.struct(pool.alias("connection_pool"), queue.alias("job_queue")))
    text = F.when(i % 40 == 11, "oops").when(i % 4 == 0, wrap(side)).when(i % 4 == 1, wrap(solid)).when(i % 4 == 2, wrap(good)).otherwise(F.to_json(F.struct(pool.alias("connection_pool"))))
    return e.select(i.alias("id"), F.col("ts").alias("occurred_at"), text.alias("system_health"))
