"""The queries over instrumentation events, webhooks, page totals and upserts, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalog import ISLANDS, LOGS, OCCURRENCES, PAIRS, SHAPE, rnd
from faultlens.catalog_json import CLOCK, CRUMBS, DAYS, HEALTH, QUERIES
from faultlens.functions import text
from faultlens.operators import filters, grouping, rangejoin, sequences, workflow
from faultlens.plans import crumbs
from faultlens.sources import driver, instrumentation

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
CUT = "2024-01-29 00:00:00"
NAMES = ["sql.active_record", "process_action.action_controller", "cache_read.active_support", "cache_write.active_support", "perform.active_job", "deliver.action_mailer", "deprecation.rails", "throttle.rack_attack", "track.rack_attack", "perform_action.action_cable", "transmit.action_cable", "transmit_subscription_confirmation.action_cable", "service_upload.active_storage", "service_streaming_download.active_storage", "service_exist.active_storage", "other.event"]
EVENTS = "ev as (select event_id as i, ts, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _events(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("event_id"), _k()
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    payload = {
        "sql": t("SELECT ", F.expr("repeat('x', cast(event_id % 300 as int))")),
        "name": F.when(i % 7 == 0, "SCHEMA").otherwise("Load"),
        "controller": t("C", k % 5),
        "action": F.when(i % 3 != 0, t("a", k % 4)),
        "key": F.when(k % 9 != 0, t("key", F.expr("repeat('k', cast(event_id % 130 as int))"))),
        "hit": F.when(k % 3 == 1, "true").when(k % 3 == 2, "false"),
        "job": F.when(k % 4 != 0, t("J", k % 6)),
        "mailer": F.lit("M"),
        "to": t("u", k),
        "message": t("old ", k),
        "caller": F.when(k % 3 != 0, t("f", k % 8)),
        "rule": t("rule", k % 4),
        "discriminator": t("ip", i % 9),
        "method": F.lit("GET"),
        "path": t("/p", k % 4),
        "channel": F.when(k % 5 != 0, t("Room", k % 3)),
        "service": F.when(k % 6 != 0, t("S", k % 2)).otherwise(""),
    }
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (i % len(NAMES) + 1).cast("int"))
    pairs = F.create_map(*[x for n, v in payload.items() for x in (F.lit(n), v)])
    return spark.read.parquet(f"{d}/events.parquet").select(F.when(i % 50 != 0, t("r", i)).alias("request_id"), name.alias("name"), F.col("ts").alias("at"), k.cast("double").alias("duration_ms"), pairs.alias("payload"))


def _event_crumbs(spark: SparkSession, d: str) -> DataFrame:
    rows = instrumentation.event_crumbs(_events(spark, d), "SELECT xx")
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rows.select("request_id", "t", "c", "m", "d", meta.alias("meta"))


def _short(n: int) -> str:
    return f"case when length(key) > {n} then substr(key, 1, {n - 3}) || '...' else key end"


ENTRIES["a10_event_crumbs"] = (
    _event_crumbs,
    f"""with {EVENTS}, e as (
  select i, ts, k, {NAMES!r}[i % {len(NAMES)} + 1] as name, 'SELECT ' || repeat('x', i % 300) as sql, case when k % 9 <> 0 then 'key' || repeat('k', i % 130) end as key,
    case when i % 3 <> 0 then 'a' || (k % 4) end as action, case when k % 5 <> 0 then 'Room' || (k % 3) else 'Unknown' end as channel, case when k % 6 <> 0 then 'S' || (k % 2) else 'Unknown' end as service,
    case i % 16 when 12 then 'upload' when 13 then 'streaming_download' when 14 then 'exist' end as op, split_part({NAMES!r}[i % {len(NAMES)} + 1], '.', 1) as kind from ev where i % 50 <> 0 and i % 16 <> 15
)
select 'r' || i as request_id, cast(floor(epoch_us(ts) / 1000) as bigint) as t,
  case when i % 16 = 0 then 'sql' when i % 16 = 1 then 'controller' when i % 16 in (2, 3) then 'cache' when i % 16 = 4 then 'job' when i % 16 = 5 then 'mailer' when i % 16 = 6 then 'deprecation' when i % 16 in (7, 8) then 'rack_attack' when i % 16 < 12 then 'action_cable' else 'active_storage' end as c,
  case i % 16 when 0 then substr(sql, 1, 200) when 1 then 'C' || (k % 5) || '#' || coalesce(action, '') when 2 then 'cache read: ' || coalesce(key, '') when 3 then 'cache write: ' || coalesce(key, '') when 4 then case when k % 4 <> 0 then 'J' || (k % 6) else 'UnknownJob' end
    when 5 then 'M to: [u' || k || ']' when 6 then 'old ' || k when 9 then 'perform: ' || channel || coalesce('#' || action, '') when 10 then 'transmit: ' || channel when 11 then 'subscribed: ' || channel
    when 12 then 'upload' || coalesce(' ' || {_short(40)}, '') || ' (' || service || ')' when 13 then 'download' || coalesce(' ' || {_short(40)}, '') || ' (' || service || ')' when 14 then 'exist?' || coalesce(' ' || {_short(40)}, '') || ' (' || service || ')'
    else kind || ': rule' || (k % 4) || ' (ip' || (i % 9) || ') GET /p' || (k % 4) end as m,
  case when i % 16 not in (6, 7, 8) then cast(k as double) end as d,
  case when i % 16 = 2 then case k % 3 when 1 then 'hit=true' when 2 then 'hit=false' else '' end when i % 16 = 6 then case when k % 3 <> 0 then 'caller=f' || (k % 8) else '' end
    when i % 16 in (7, 8) then 'discriminator=ip' || (i % 9) || ',method=GET,path=/p' || (k % 4) || ',rule=rule' || (k % 4) || ',type=' || kind
    when i % 16 in (9, 10, 11) then concat_ws(',', 'action=' || action, 'channel=' || channel, 'event_type=' || kind)
    when i % 16 > 11 then concat_ws(',', 'key=' || {_short(100)}, 'operation=' || op, 'service=' || service) else '' end as meta
from e where not (i % 16 = 0 and (i % 7 = 0 or contains(sql, 'SELECT xx')))""",
)

# webhooks
SECRET = "whsec-" + "0123456789" * 3
ACTIONS = "['closed', 'reopened', 'opened'][i % 3 + 1]"
BODY = f"""case when i % 4 in (0, 2) then '{{"action":"' || {ACTIONS} || '","issue":{{"number":' || k || '}},"sender":{{"login":"dev' || (k % 5) || '"}}}}'
  when i % 4 = 1 then '{{"object_attributes":{{"action":"' || ['close', 'reopen', 'open'][i % 3 + 1] || '","iid":' || k || '}},"user":{{"username":"ü' || (k % 5) || '"}}}}'
  else '{{"type":"Issue","action":"update",' || case when k % 2 = 0 then '"updatedFrom":{{"stateId":"s"}},' else '"updatedFrom":{{}},' end || '"data":{{"number":' || k || ',"state":{{"type":"' || ['completed', 'started', 'other'][i % 3 + 1] || '"}}}},"actor":{{"name":"dev' || (k % 5) || '"}}}}' end"""


def _webhooks(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("i"), F.col("k")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    forge = t('{"action":"', pick("closed", "reopened", "opened"), '","issue":{"number":', k, '},"sender":{"login":"dev', k % 5, '"}}')
    lab = t('{"object_attributes":{"action":"', pick("close", "reopen", "open"), '","iid":', k, '},"user":{"username":"ü', k % 5, '"}}')
    line = t('{"type":"Issue","action":"update",', F.when(k % 2 == 0, '"updatedFrom":{"stateId":"s"},').otherwise('"updatedFrom":{},'), '"data":{"number":', k, ',"state":{"type":"', pick("completed", "started", "other"), '"}},"actor":{"name":"dev', k % 5, '"}}')
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("i"), F.col("ts").alias("at"), _k().alias("k"))
    body = F.when(i % 4 == 1, lab).when(i % 4 == 3, line).otherwise(forge)
    return rows.select("i", "at", pick("github", "gitlab", "codeberg", "linear").alias("provider"), body.alias("body"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    sent = F.when(F.col("provider") == "gitlab", SECRET).when(F.col("provider") == "github", F.concat(F.lit("sha256="), instrumentation.hmac_sha256(F.col("body"), SECRET))).otherwise(instrumentation.hmac_sha256(F.col("body"), SECRET))
    signed = _webhooks(spark, d).withColumn("signature", F.when(F.col("i") % 5 != 0, sent).when(F.col("i") % 10 != 0, "sha256=00"))
    return instrumentation.webhook_changes(signed, SECRET).withColumn("at", F.col("at").cast("string").substr(1, 19))


def _pad(x: int) -> str:
    return bytes(b ^ x for b in SECRET.encode().ljust(64, b"\0")).hex()


ENTRIES["a14_webhook_digests"] = (lambda spark, d: _webhooks(spark, d).select(F.col("i").alias("id"), instrumentation.hmac_sha256(F.col("body"), SECRET).alias("digest")), f"with {EVENTS}, w as (select i, {BODY} as body from ev) select i as id, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(body)))) as digest from w")
ENTRIES["a14_webhook_changes"] = (
    _changes,
    f"""with {EVENTS} select ['github', 'gitlab', 'codeberg', 'linear'][i % 4 + 1] as provider, k as number, case i % 3 when 0 then 'resolve' else 'reopen' end as change,
  case when i % 3 = 0 then ['Closed on GitHub by dev', 'Closed on GitLab by ü', 'Closed on Codeberg by dev', 'Completed on Linear by dev'][i % 4 + 1] || (k % 5) end as comment, strftime(ts, '%Y-%m-%d %H:%M:%S') as at
from ev where i % 5 <> 0 and i % 3 <> 2 and (i % 4 <> 3 or k % 2 = 0)""",
)

# page totals
_TOTALS = {
    "deprecation": [("unique", "count(distinct (m, case when q % 2 = 0 then 'file' || (supp % 3) else '' end))"), ("total", "count(*)"), ("affected", "count(distinct id)")],
    "rack_attack": [("unique", "count(distinct supp % 4)"), ("total", "count(*)"), ("unique_ips", "count(distinct part % 9)")],
    "action_cable": [("unique", "count(distinct case when q % 5 <> 0 then supp % 3 else -1 end)"), ("total", "count(*)"), ("rejections", "count(*) filter (q % 4 = 3)")],
    "active_storage": [("unique", "count(distinct case when q % 6 <> 0 then supp % 2 else -1 end)"), ("total", "count(*)"), ("group_errors", "count(distinct (id, case when q % 6 <> 0 then supp % 2 else -1 end))")],
}
_PARTS = [f"select '{c}' as page, '{n}' as measure, cast({x} as double) as value from cr where c = '{c}' and m <> '' having count(*) > 0" for c, v in _TOTALS.items() for n, x in v]
_PARTS += [f"select 'repeated_queries', '{n}', cast({x} as double) from nq" for n, x in (("unique", "count(distinct fingerprint)"), ("total", "sum(n)"), ("affected", "count(distinct id)"))]
_CACHE = f"ca as (select id, count(*) as ops, case when count(*) filter (q % 3 <> 0) > 0 then {rnd('(count(*) filter (q % 3 = 1) * 100.0 / count(*) filter (q % 3 <> 0))', 1)} end as rate from cr where c = 'cache' group by 1)"
_PARTS += [f"select 'cache', '{n}', cast({x} as double) from ca" for n, x in (("errors", "count(*)"), ("avg_hit_rate", rnd("avg(rate)", 1)), ("total", "sum(ops)"))]
ENTRIES["d49_crumb_page_totals"] = (lambda spark, d: crumbs.page_totals(driver.breadcrumb_logs(spark, d), F.lit(CLOCK).cast("timestamp_ntz"), DAYS), f"with {CRUMBS}, {QUERIES}, {_CACHE} " + " union all ".join(_PARTS))
_HEALTH = {"job_queues": ("i % 4 <> 3", [("errors", "count(*)"), ("failed", "sum(case i % 4 when 0 then i % 17 when 1 then i % 13 else i % 7 end)"), ("adapters", "count(distinct i % 4)")]), "pools": ("true", [("errors", "count(*)"), ("max_utilization", f"max({rnd('((k % 5) * 100.0 / (5 + k % 5))', 1)})"), ("dead", "sum(i % 3)"), ("waiting", "sum(i % 6)")])}
ENTRIES["d49_health_page_totals"] = (lambda spark, d: crumbs.health_totals(driver.health_logs(spark, d), driver.as_of(), 60), f"with {HEALTH} " + " union all ".join(f"select '{p}' as page, '{n}' as measure, cast({x} as double) as value from hl where {where}" for p, (where, v) in _HEALTH.items() for n, x in v))


# upserts
def on_logs(name: str, plan: Callable[[DataFrame], DataFrame], sql: str) -> None:
    ENTRIES[name] = (lambda spark, d: plan(driver.error_logs(spark, d)), f"with {LOGS} {sql}")


def _halves(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(CUT).cast("timestamp_ntz")
    return logs.filter(F.col("occurred_at") < cut), logs.filter(F.col("occurred_at") >= cut)


def _merged(logs: DataFrame) -> DataFrame:
    out = grouping.merged_groups(*_halves(logs), F.lit(CUT).cast("timestamp_ntz"))
    return out.select("application_id", "error_hash", "id", F.col("occurrence_count").cast("long").alias("occurrence_count"), "last_seen_at", "resolved", "status", "reopened_at")


on_logs("i1_merged_groups", _merged, f""", g as (select * from logs where occurred_at < timestamp '{CUT}'),
b as (select application_id, error_hash, count(*) as n, max(occurred_at) as l from logs where occurred_at >= timestamp '{CUT}' group by 1, 2),
c as (select *, case when not resolved and occurred_at >= timestamp '{CUT}' - interval 24 hour then 0 when status in ('resolved', 'wont_fix') then 1 end as r from g),
p as (select application_id, error_hash, id, r from (select *, row_number() over (partition by application_id, error_hash order by r, occurred_at desc, id) as z from c where r is not null) where z = 1),
t as (select b.*, p.id, p.r from b left join p using (application_id, error_hash))
select g.application_id, g.error_hash, g.id, cast(g.occurrence_count + coalesce(n, 0) as bigint) as occurrence_count, greatest(g.last_seen_at, coalesce(l, g.last_seen_at)) as last_seen_at, g.resolved and coalesce(r, 0) <> 1 as resolved,
  case when r = 1 then 'new' else status end as status, case when r = 1 then timestamp '{CUT}' else reopened_at end as reopened_at from g left join t on g.id = t.id
union all select application_id, error_hash, null, n, l, false, 'new', null from t where id is null""")


def _counters(logs: DataFrame) -> DataFrame:
    hour = F.date_trunc("HOUR", "occurred_at").cast("timestamp_ntz")
    place = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, F.concat(F.lit("r"), (F.col("k") % 4).cast("string")))
    rows = logs.select(F.when(F.col("k") != 50, F.col("error_type")).otherwise(" ").alias("exception_class"), F.concat(F.lit("f"), (F.col("k") % 5).cast("string")).alias("raise_location"), place.alias("rescue_location"), hour.alias("period_hour"), "application_id", (F.col("k") % 2).alias("raise_count"), (F.col("k") % 7).cast("long").alias("rescue_count"), F.col("occurred_at").alias("last_seen_at"))
    none = rows.limit(0)
    return workflow.added_counters(workflow.added_counters(none, rows.filter("day(period_hour) < 15")), rows.filter("day(period_hour) >= 15 or hour(period_hour) = 7"))


on_logs("i6_swallowed_upsert", _counters, """, r as (select error_type as exception_class, 'f' || (k % 5) as raise_location, case when k % 3 = 1 then 'r' || (k % 4) end as rescue_location, date_trunc('hour', occurred_at) as period_hour, application_id, k % 2 as a, k % 7 as b, occurred_at from logs where k <> 50),
u as (select * from r where day(period_hour) < 15 union all select * from r where day(period_hour) >= 15 or hour(period_hour) = 7)
select exception_class, raise_location, rescue_location, period_hour, application_id, cast(sum(a) as bigint) as raise_count, cast(sum(b) as bigint) as rescue_count, max(occurred_at) as last_seen_at from u group by 1, 2, 3, 4, 5""")
on_logs("i10_batch_counts", lambda logs: workflow.batch_counts(logs, [1, 2, 3, 3, -7]), "select cast(4 as bigint) as asked, count(*) as found, 4 - count(*) as missing from logs where id in (1, 2, 3, -7)")
KIND = "case k % 3 when 0 then 'hourly' when 1 then 'daily' else 'weekly' end"


def _base(logs: DataFrame) -> DataFrame:
    kind = F.when(F.col("k") % 3 == 0, "hourly").when(F.col("k") % 3 == 1, "daily").otherwise("weekly")
    return logs.groupBy("error_type", "platform", kind.alias("baseline_type"), F.dayofmonth("occurred_at").alias("period_start")).agg(F.sum("k").alias("total"))


on_logs("g12_latest_baseline", lambda logs: sequences.nearest_baseline(_base(logs), "period_start"), f", b as (select error_type, platform, {KIND} as baseline_type, cast(dom as integer) as period_start, cast(sum(k) as bigint) as total from logs join (select event_id as id, dom from e0) using (id) group by 1, 2, 3, 4) select error_type, platform, baseline_type, period_start, total from (select *, row_number() over (partition by error_type, platform order by case baseline_type when 'hourly' then 0 when 'daily' then 1 else 2 end, period_start desc) as z from b) where z = 1")
on_logs("i8_baseline_upsert", lambda logs: sequences.upserted_baselines(_base(logs.filter("day(occurred_at) < 20")), _base(logs.filter("day(occurred_at) > 10 and id % 2 = 0")), ["error_type", "platform", "baseline_type", "period_start"]), f""", d as (select *, {KIND} as baseline_type, cast(day(occurred_at) as integer) as period_start from logs),
o as (select error_type, platform, baseline_type, period_start, cast(sum(k) as bigint) as total from d where period_start < 20 group by 1, 2, 3, 4), n as (select error_type, platform, baseline_type, period_start, cast(sum(k) as bigint) as total from d where period_start > 10 and id % 2 = 0 group by 1, 2, 3, 4)
select * from n union all select * from o where not exists (select 1 from n where n.error_type = o.error_type and n.platform is not distinct from o.platform and n.baseline_type = o.baseline_type and n.period_start = o.period_start)""")
on_logs("i13_applications", lambda logs: workflow.with_applications(logs.filter("user_id < 100").select(F.col("error_type").alias("name"), F.lit(1).alias("id")).distinct(), logs.select(F.col("error_hash").substr(1, 12).alias("name"))), ", a as (select distinct error_type as name from logs where user_id < 100) select name, 1 as id from a union all select distinct substr(error_hash, 1, 12), null from logs where substr(error_hash, 1, 12) not in (select name from a)")

# one error, and cascades
OWN = "logs as (select * from all_logs where error_type = (select error_type from all_logs where id = 500) and platform is not distinct from (select platform from all_logs where id = 500))"
OF_ERROR = f"with {LOGS.replace('), logs as (', '), all_logs as (')}, {OWN}"
ENTRIES["g14_pattern_of_error"] = (lambda spark, d: sequences.cyclical(sequences.of_error(driver.error_logs(spark, d), 500, driver.as_of(), 30), ["error_type"]), f"{OF_ERROR}, {SHAPE} select * from cy")
ENTRIES["g14_bursts_of_error"] = (lambda spark, d: sequences.bursts(sequences.of_error(driver.error_logs(spark, d), 500, driver.as_of(), 40), ["error_type"], gap=36000).select("start", "end", "n"), f'{OF_ERROR}, {ISLANDS.format(key="error_type", gap="cast(36000 as bigint)", least=5)} select start, "end", n from bu')


def _scopes(occ: DataFrame) -> DataFrame:
    edges = rangejoin.with_probability(rangejoin.cascades(occ), occ)
    return edges.agg(*[F.count_if(c).alias(n) for n, c in filters.cascade_scopes(4).items()])


ENTRIES["b17_cascade_scopes"] = (lambda spark, d: _scopes(driver.occurrences(spark, d)), f"with {OCCURRENCES}, {PAIRS} select count(*) filter (cascade_probability >= 0.7) as high_confidence, count(*) filter (frequency >= 4) as frequent, count(*) filter (cascade_probability >= 0.7 and frequency >= 3) as strong from ep")

# agents and paths
AGENTS = {"Mozilla/5.0 (iPhone; CPU iPhone OS 17_0)": "iOS", "Mozilla/5.0 (iPad; CPU OS 17_0)": "iOS", "Dalvik/2.1.0 (Linux; Android 14)": "Android", "Expo/1 CFNetwork Darwin": "Mobile", "Expo/1 iOS/17": "iOS", "": "API", "curl/8.0": "API"}
ENTRIES["f25_platforms"] = (lambda spark, d: driver.error_logs(spark, d).groupBy(text.platform_of(F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("k") % len(AGENTS) + 1).cast("int"))).alias("platform")).agg(F.count("*").alias("n")), f"with {LOGS} select {list(AGENTS.values())!r}[k % {len(AGENTS)} + 1] as platform, count(*) as n from logs group by 1")
PATHS = {"/usr/gems/rack-2.0/lib/rack.rb:3": "gems/rack-2.0/lib/rack.rb:3", "/opt/lib/ruby/3.3/set.rb:9": "ruby/3.3/set.rb:9", "/srv/x/app/models/a.rb:1": "app/models/a.rb:1", "/srv/lib/t.rb:2": "lib/t.rb:2", "plain.rb:4": "plain.rb:4"}
ENTRIES["f18_short_paths"] = (lambda spark, d: driver.error_logs(spark, d).groupBy(text.short_path(F.element_at(F.array(*[F.lit(a) for a in PATHS]), (F.col("k") % len(PATHS) + 1).cast("int"))).alias("path")).agg(F.count("*").alias("n")), f"with {LOGS} select {list(PATHS.values())!r}[k % {len(PATHS)} + 1] as path, count(*) as n from logs group by 1")
