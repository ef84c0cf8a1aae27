"""Sources and sinks: crash files, reported errors, instrumentation events, webhooks, notifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.severity import severity
from faultlens.functions.text import backtrace_signature, error_hash, masked_causes, masked_json, masked_message, masked_url, platform_of, truncated_backtrace
from faultlens.operators.filters import ignored, sampled

REPORT = "error_type string, message string, backtrace string, user_id long, request_url string, request_params string, user_agent string, ip_address string, controller_name string, action_name string, application_id long, app_version string, git_sha string, platform string, occurred_at timestamp_ntz, handled boolean, level string, request_id string"


def reports(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Reported errors as JSON lines. A line that doesn't parse has _corrupt_record."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(REPORT + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def crash_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole-file JSON crash reports under a glob: (good ones, paths of bad ones)."""
    files = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = files.withColumn("r", F.from_json("value", REPORT + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.filter(~bad).select("r.*", "file").drop("_corrupt_record"), parsed.filter(bad).select("file")


def prepared(rows: DataFrame, ignore: list[str] = (), ignore_patterns: list[str] = (), rate: float = 1.0, custom_fingerprint: Column | None = None, custom_severity: dict[str, str] | None = None) -> DataFrame:
    """Reports ready to be grouped: filtered, sampled, keyed and masked. Handled warnings are no errors."""
    level = severity(F.col("error_type"), custom_severity)
    quiet = F.coalesce(F.col("handled") & (F.col("level") == "warning"), F.lit(False))
    kept = rows.filter(~quiet & ~ignored(F.col("error_type"), ignore, ignore_patterns) & sampled(F.concat_ws("|", "error_type", "message", F.col("occurred_at").cast("string")), level, rate))
    key = error_hash(F.col("error_type"), F.col("message"), F.col("backtrace"), F.col("controller_name"), F.col("action_name"), F.col("application_id"), custom_fingerprint)
    if "exception_cause" in rows.columns:
        kept = kept.withColumn("exception_cause", masked_causes(F.col("exception_cause")))
    return kept.withColumns({"error_hash": key, "backtrace_signature": backtrace_signature(F.col("backtrace")), "severity": level, "platform": F.coalesce("platform", platform_of(F.col("user_agent")))}).withColumns({"message": masked_message(F.col("message")), "request_url": masked_url(F.col("request_url")), "request_params": masked_json(F.col("request_params")), "backtrace": truncated_backtrace(F.col("backtrace"))})


def once_per_request(rows: DataFrame) -> DataFrame:
    """An error that several layers of one request report is taken once; reports without a request all stay."""
    return rows.filter("request_id is not null").dropDuplicates(["request_id", "error_hash"]).union(rows.filter("request_id is null"))


def llm_crumbs(spans: DataFrame) -> DataFrame:
    """Spans (request_id, started_at, duration_ms, attributes map) -> crumbs, whichever convention names the attributes."""
    a = F.col("attributes")
    first = lambda *names: F.coalesce(*[a[n] for n in names])
    meta = F.map_filter(F.create_map(*[x for k, v in {"provider": first("gen_ai.system", "gen_ai.provider.name", "llm.provider"), "model": first("gen_ai.response.model", "gen_ai.request.model", "llm.model"), "input_tokens": first("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.usage.prompt_tokens"), "output_tokens": first("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.usage.completion_tokens"), "status": F.when(a["error.type"].isNotNull(), "error").otherwise("success"), "error_class": a["error.type"], "duration_ms": F.col("duration_ms").cast("string")}.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    kind = F.when(first("gen_ai.tool.name", "llm.tool.name").isNotNull(), "llm_tool").otherwise("llm")
    return spans.select("request_id", F.unix_millis(F.col("started_at").cast("timestamp")).alias("t"), kind.alias("c"), F.coalesce(a["gen_ai.operation.name"], kind).alias("m"), F.col("duration_ms").cast("double").alias("d"), meta.alias("meta"))


def by_issue(logs: DataFrame, number: int, provider: str) -> DataFrame:
    return logs.filter((F.col("external_issue_number") == number) & (F.col("external_issue_provider") == provider))


def payloads(rows: DataFrame, kind: str = "webhook") -> DataFrame:
    """(id, payload): one JSON text per notification."""
    title = F.concat_ws(": ", "error_type", F.substring("message", 1, 200))
    body = {"webhook": F.struct(F.lit("error").alias("event"), F.struct(*rows.columns).alias("error")), "slack": F.struct(title.alias("text")), "discord": F.struct(title.alias("content")), "pagerduty": F.struct(F.lit("trigger").alias("event_action"), F.struct(title.alias("summary"), F.lit("critical").alias("severity")).alias("payload"))}[kind]
    return rows.select("id", F.to_json(body).alias("payload"))


def notify_sink(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Every micro-batch goes to ``send`` (batch, number); a number that comes again is the same batch."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def markdown(rows: DataFrame) -> DataFrame:
    """(id, text): an error as Markdown."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n- **{name}:** "), F.col(c).cast("string"))).otherwise("")
    parts = [line(n, c) for n, c in (("Platform", "platform"), ("Version", "app_version"), ("Commit", "git_sha"), ("Occurrences", "occurrence_count"), ("First seen", "first_seen_at"), ("Last seen", "last_seen_at")) if c in rows.columns]
    return rows.select("id", F.concat(F.lit("# "), F.col("error_type"), F.lit("\n\n"), F.col("message"), F.lit("\n"), *parts).alias("text"))


def curl(rows: DataFrame) -> DataFrame:
    """(id, text): the request as a command line."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    agent = F.when(F.col("user_agent").isNotNull(), F.concat(F.lit(" -H "), quoted(F.concat(F.lit("User-Agent: "), F.col("user_agent"))))).otherwise("")
    return rows.select("id", F.concat(F.lit("curl -X "), F.coalesce("http_method", F.lit("GET")), agent, F.lit(" "), quoted(F.col("request_url"))).alias("text"))


def recent_dumps(dumps: DataFrame, limit: int = 10) -> DataFrame:
    return dumps.orderBy(F.col("captured_at").desc(), "id").limit(limit)
