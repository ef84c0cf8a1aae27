"""Queries over lists, renderings and text functions, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalog import AS_OF, LOGS, SEVERITY, rnd, since
from faultlens.catalog_json import CLOCK, CRUMBS, DAYS
from faultlens.functions import text
from faultlens.functions.severity import severity
from faultlens.operators import filters
from faultlens.plans import crumbs, dashboard, lifecycle
from faultlens.sources import driver, ingest

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def on_logs(name: str, plan: Callable[[DataFrame], DataFrame], sql: str) -> None:
    ENTRIES[name] = (lambda spark, d: plan(driver.error_logs(spark, d)), f"with {LOGS} {sql}")


# lists
SPANS = {"last_hour": since(1 / 24), "today": f"occurred_at >= date_trunc('day', {AS_OF})", "yesterday": f"occurred_at >= date_trunc('day', {AS_OF}) - interval 24 hour and occurred_at < date_trunc('day', {AS_OF})", "last_7_days": since(7), "last_30_days": since(30), "last_90_days": since(90)}


def _spans(logs: DataFrame) -> DataFrame:
    out = None
    for name in SPANS:
        rows = filters.errors_list(logs, {"timeframe": name, "unresolved": False}, driver.as_of()).groupBy("platform").agg(F.count("*").alias("n"), F.min("id").alias("least_id")).withColumn("timeframe", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


on_logs("b8_timeframes", _spans, " union all ".join(f"select '{n}' as timeframe, platform, count(*) as n, min(id) as least_id from logs where {w} group by platform" for n, w in SPANS.items()))


def _placed(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of a sorted list with their places: they come in one partition, in order."""
    return rows.limit(n).withColumn("place", F.monotonically_increasing_id() + 1)


def _sorted(logs: DataFrame) -> DataFrame:
    """Heads of the error list by three sorts, as the pages show them."""
    out = None
    for by, direction in (("error_type", "asc"), ("occurrence_count", "desc"), ("no_such_column", "asc")):
        rows = _placed(filters.errors_list(logs, {"sort_by": by, "sort_direction": direction}, driver.as_of()).select("id"), 60).withColumn("sort", F.lit(f"{by} {direction}"))
        out = rows if out is None else out.unionByName(rows)
    return out


_HEAD = "select id, row_number() over (order by {order}) as place, '{sort}' as sort from logs where not resolved qualify place <= 60"
on_logs("h1_sorted_lists", _sorted, " union all ".join(f"select * from ({_HEAD.format(order=o, sort=s)})" for o, s in (("error_type, occurred_at desc, id", "error_type asc"), ("occurrence_count desc, occurred_at desc, id", "occurrence_count desc"), ("occurred_at, id", "no_such_column asc"))))


def _emails(spark: SparkSession, d: str) -> DataFrame:
    accounts = spark.read.parquet(f"{d}/customer.parquet").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"))
    return dashboard.top_users(driver.error_logs(spark, d), driver.as_of(), accounts, 30, 50)


ENTRIES["c2_users_with_emails"] = (
    _emails,
    f"""with {LOGS}, u as (select user_id, count(*) as n from logs where {since(30)} and user_id is not null group by 1 order by n desc, user_id limit 50)
select user_id, coalesce(lower(replace(c_name, '#', '.')) || '@example.com', 'User #' || user_id) as email, n from u left join (select * from customer where c_custkey % 3 > 0) on c_custkey = user_id""",
)


def _total_users(spark: SparkSession, d: str) -> DataFrame:
    logs = driver.error_logs(spark, d)
    accounts = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return lifecycle.user_impact_of_all(logs, accounts, driver.as_of())


ENTRIES["f35_impact_of_all_users"] = (
    _total_users,
    f"with {LOGS} select error_type, count(distinct user_id) as users, (select count(*) from customer) as total_users, {rnd('(count(distinct user_id) * 100.0 / (select count(*) from customer))', 1)} as impact from logs where {since(30)} group by 1 having count(distinct user_id) > 0",
)

# breadcrumbs
ENTRIES["e5_cache_list"] = (
    lambda spark, d: _placed(crumbs.cache_list(driver.breadcrumb_logs(spark, d), F.lit(CLOCK).cast("timestamp_ntz"), DAYS).select("id", "hit_rate"), 100),
    f"""with {CRUMBS}, a as (select id, count(*) filter (q % 3 = 1) as hits, count(*) filter (q % 3 = 2) as misses from cr where c = 'cache' group by 1),
b as (select id, case when hits + misses <> 0 then {rnd('(hits * 100.0 / (hits + misses))', 1)} end as hit_rate from a)
select id, hit_rate, row_number() over (order by hit_rate nulls last, id) as place from b qualify place <= 100""",
)


# renderings
def _rendered(logs: DataFrame) -> DataFrame:
    rows = logs.select("id", "error_type", "message", "platform", "app_version", "git_sha", "occurrence_count", F.col("error_hash").alias("user_agent"), F.when(F.col("k") % 2 == 0, "POST").alias("http_method"), F.concat(F.lit("https://x.example/it's?k="), F.col("k").cast("string")).alias("request_url"))
    return ingest.markdown(rows).join(ingest.curl(rows.withColumn("user_agent", F.when(F.col("id") % 3 > 0, F.col("user_agent")))).withColumnRenamed("text", "curl"), "id")


_LINE = lambda n, c: f"coalesce(chr(10) || '- **{n}:** ' || {c}, '')"
on_logs(
    "a19_rendered",
    _rendered,
    f"""select id, '# ' || error_type || chr(10) || chr(10) || message || chr(10) || {_LINE('Platform', 'platform')} || {_LINE('Version', 'app_version')} || {_LINE('Commit', 'git_sha')} || {_LINE('Occurrences', 'occurrence_count')} as text,
  'curl -X ' || case when k % 2 = 0 then 'POST' else 'GET' end || case when id % 3 > 0 then ' -H ''User-Agent: ' || error_hash || '''' else '' end || ' ''https://x.example/it''\\''''s?k=' || k || '''' as curl from logs""",
)
on_logs(
    "a18_digest_lines",
    lambda logs: lifecycle.digest_lines(logs, driver.as_of(), 7),
    f"""select section, place, line from (
  select 'urgent' as section, row_number() over (order by occurred_at desc, id) as place, '[' || upper({SEVERITY}) || '] ' || error_type || ': ' || message as line from logs where {since(7)} and not resolved and {SEVERITY} in ('critical', 'high') qualify place <= 5
) union all select * from (
  select 'top', row_number() over (order by n desc, error_type) as place, error_type || ' (' || n || 'x): ' || message from (select error_type, count(*) as n, arg_max(message, (occurred_at, id)) as message from logs where {since(7)} and not resolved group by 1) qualify place <= 5
)""",
)

# back traces, fingerprints, agents
#: Lines of back traces, and the frames that the hash takes of them; none of foreign code.
LINES = [("/srv/app/models/user.rb:10:in `save'", "app/models/user.rb:save"), ("/bundle/gems/rack-2/lib/rack.rb:3:in `call'", None), ("  lib/tool.rb:7", "lib/tool.rb"), ("/usr/lib/ruby/3.3/set.rb:9:in `add'", None), ("config.ru:3:in `run'", ""), ("/opt/ruby-3.3.1/lib/net.rb:1:in `get'", None), ("/x/vendor/bundle/a.rb:2:in `b'", None), ("/srv/app/x/app/jobs/j.rb:5:in `block in run'", "app/jobs/j.rb:block in run")]


def _traces(logs: DataFrame) -> DataFrame:
    at = lambda m, plus: F.element_at(F.array(*[F.lit(x) for x, _ in LINES]), ((F.col("k") * m + plus) % len(LINES) + 1).cast("int"))
    trace = F.when(F.col("k") % 11 > 0, F.concat_ws("\n", *[at(m, p) for m, p in ((1, 0), (3, 1), (5, 2), (7, 4), (1, 5), (1, 3))]))
    return logs.withColumn("backtrace", trace)


_FRAMES = "[" + ", ".join("null" if f is None else f"'{f}'" for _, f in LINES) + "]"
_AT = [f"{_FRAMES}[(k * {m} + {p}) % {len(LINES)} + 1]" for m, p in ((1, 0), (3, 1), (5, 2), (7, 4), (1, 5), (1, 3))]
TRACED = f"tr as (select *, case when k % 11 > 0 then nullif(array_to_string(list_filter(list_filter([{', '.join(_AT)}], lambda x: x is not null)[1:3], lambda x: x <> ''), '|'), '') end as frames from logs)"
on_logs("f11_significant_frames", lambda logs: _traces(logs).select("id", text.significant_frames(F.col("backtrace")).alias("frames")), f", {TRACED} select id, frames from tr")
on_logs(
    "f13_hash_with_frames",
    lambda logs: _traces(logs).select("id", text.error_hash(F.col("error_type"), F.lit("m"), F.col("backtrace"), F.lit("c"), F.when(F.col("k") % 2 == 0, "a"), F.col("application_id"), F.when(F.col("k") % 5 == 0, F.col("git_sha"))).alias("hash")),
    f", {TRACED} select id, substr(sha256(case when k % 5 = 0 and coalesce(git_sha, '') <> '' then git_sha else concat_ws('|', error_type, 'm', frames, 'c', case when k % 2 = 0 then 'a' end, application_id) end), 1, 16) as hash from tr",
)
on_logs(
    "f19_truncated_traces",
    lambda logs: logs.select("id", text.truncated_backtrace(F.array_join(F.transform(F.sequence(F.lit(1), F.col("k") + 1), lambda i: F.concat(F.lit("/r/gems/g/l.rb:"), i.cast("string"))), "\n"), 30).alias("backtrace")),
    "select id, array_to_string(list_transform(range(1, least(k + 1, 30) + 1), lambda i: 'gems/g/l.rb:' || i), chr(10)) || case when k + 1 > 30 then chr(10) || '... (' || (k - 29) || ' more lines truncated)' else '' end as backtrace from logs",
)


def _causes(logs: DataFrame) -> DataFrame:
    """Digests of the chains of errors with up to 8 causes, of which each is longer than the one before."""
    t = lambda name, i: F.concat(F.lit(name), i.cast("string"))
    one = lambda i: F.struct(t("E", i).alias("class_name"), F.repeat(F.lit("m"), i * 300).alias("message"), F.transform(F.sequence(F.lit(1), i * 7), lambda j: t("f.rb:", j)).alias("backtrace"))
    causes = F.transform(F.sequence(F.lit(1), F.col("k") % 8 + 1), one)
    return logs.select("id", F.sha2(text.cause_chain(F.when(F.col("k") % 9 > 0, causes).otherwise(F.slice(causes, 1, 0))), 256).alias("digest"))


on_logs(
    "f36_cause_chains",
    _causes,
    """select id, case when k % 9 > 0 then sha256('[' || array_to_string(list_transform(range(1, least(k % 8 + 1, 5) + 1), lambda i: '{"class_name":"E' || i || '","message":"' || repeat('m', least(i * 300, 1000)) || '","backtrace":["'
  || array_to_string(list_transform(range(1, least(i * 7, 20) + 1), lambda j: 'f.rb:' || j), '","') || '"]}'), ',') || ']') end as digest from logs""",
)
#: User agents with their browser, system and device.
AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Edg/120": ("Edge", "Windows"),
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Safari/604": ("Safari", "iOS"),
    "Mozilla/5.0 (Linux; Android 14) Chrome/120": ("Chrome", "Android"),
    "Mozilla/5.0 (X11; Linux) Firefox/121": ("Firefox", "Linux"),
    "": ("Unknown", "Unknown"),
}


def _agents(logs: DataFrame) -> DataFrame:
    parts = text.user_agent_parts(F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("k") % len(AGENTS) + 1).cast("int")))
    return logs.groupBy(parts["browser"].alias("browser"), parts["os"].alias("os")).agg(F.count("*").alias("n"))


on_logs("f38_user_agents", _agents, f"select {[b for b, _ in AGENTS.values()]!r}[k % {len(AGENTS)} + 1] as browser, {[o for _, o in AGENTS.values()]!r}[k % {len(AGENTS)} + 1] as os, count(*) as n from logs group by 1, 2")


# spans, issues, dumps, configuration
def _spans(logs: DataFrame) -> DataFrame:
    """Spans of two conventions, tools among them, as crumbs with their meta as text."""
    k, text_of = F.col("k"), lambda c: c.cast("string")
    gen = {"gen_ai.system": F.lit("openai"), "gen_ai.request.model": F.when(k % 3 == 0, "gpt-4o").otherwise("o1"), "gen_ai.response.model": F.when(k % 7 == 0, "gpt-4o-mini"), "gen_ai.usage.input_tokens": text_of(k), "gen_ai.usage.completion_tokens": text_of(k * 2), "gen_ai.operation.name": F.when(k % 4 > 0, "chat"), "error.type": F.when(k % 5 == 0, "Timeout"), "gen_ai.tool.name": F.when(k % 6 == 0, "search")}
    old = {"llm.provider": F.lit("local"), "llm.model": F.lit("m"), "llm.usage.prompt_tokens": text_of(k)}
    pairs = lambda names: F.map_filter(F.create_map(*[x for n, v in names.items() for x in (F.lit(n), v)]), lambda n, v: v.isNotNull())
    attributes = F.when(F.col("id") % 2 == 0, pairs(gen)).otherwise(pairs(old))
    spans = logs.select(F.col("id").cast("string").alias("request_id"), F.col("occurred_at").alias("started_at"), (k * 3).alias("duration_ms"), attributes.alias("attributes"))
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return ingest.llm_crumbs(spans).select("request_id", "t", "c", "m", "d", meta.alias("meta"))


on_logs(
    "a12_span_crumbs",
    _spans,
    """select cast(id as varchar) as request_id, cast(floor(epoch_us(occurred_at) / 1000) as bigint) as t, case when id % 2 = 0 and k % 6 = 0 then 'llm_tool' else 'llm' end as c,
  case when id % 2 = 0 and k % 4 > 0 then 'chat' when id % 2 = 0 and k % 6 = 0 then 'llm_tool' else 'llm' end as m, cast(k * 3 as double) as d,
  case when id % 2 = 0 then concat_ws(',', 'duration_ms=' || (k * 3), case when k % 5 = 0 then 'error_class=Timeout' end, 'input_tokens=' || k, 'model=' || case when k % 7 = 0 then 'gpt-4o-mini' when k % 3 = 0 then 'gpt-4o' else 'o1' end, 'output_tokens=' || (k * 2), 'provider=openai', 'status=' || case when k % 5 = 0 then 'error' else 'success' end)
    else 'duration_ms=' || (k * 3) || ',input_tokens=' || k || ',model=m,provider=local,status=success' end as meta from logs""",
)
on_logs(
    "c15_by_issue",
    lambda logs: ingest.by_issue(logs.withColumn("external_issue_number", F.col("k")).withColumn("external_issue_provider", F.when(F.col("id") % 2 == 0, "github").otherwise("gitlab")), 42, "github").select("id", "error_type"),
    "select id, error_type from logs where k = 42 and id % 2 = 0",
)
on_logs("a20_recent_dumps", lambda logs: ingest.recent_dumps(logs.filter("k % 9 = 0").select("id", F.col("occurred_at").alias("captured_at")), 25), "select id, occurred_at as captured_at from logs where k % 9 = 0 order by captured_at desc, id limit 25")
CUSTOM = {"TypeError": "critical", "CustomClickError": "high", "SecurityError": "low"}
on_logs(
    "j2_custom_severities",
    lambda logs: logs.groupBy(severity(F.col("error_type"), CUSTOM).alias("severity")).agg(F.count("*").alias("n")),
    "select case " + " ".join(f"when error_type = '{t}' then '{v}'" for t, v in CUSTOM.items()) + f" else {SEVERITY} end as severity, count(*) as n from logs group by 1",
)
on_logs(
    "j3_price_overrides",
    lambda logs: logs.select("id", text.llm_cost(F.when(F.col("k") % 2 == 0, "Own-Model").otherwise("gpt-4o"), F.col("k"), F.when(F.col("k") % 3 > 0, F.col("k") * 2), {"own-model": (1.5, 2.0), "gpt-4o": (1.0, 4.0)}).alias("cost")),
    f"select id, {rnd('((k * case when k % 2 = 0 then 1.5 else 1.0 end + case when k % 3 > 0 then k * 2 else 0 end * case when k % 2 = 0 then 2.0 else 4.0 end) / 1000000.0)', 6)} as cost from logs",
)
