"""The queries over JSON columns, similarity and text search, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalog import rnd
from faultlens.functions import numbers, text
from faultlens.plans import crumbs, similar
from faultlens.sources import driver

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
CLOCK, DAYS = "2001-08-01 00:00:00", 1500
SINCE = f"timestamp '{CLOCK}' - interval {DAYS} day"

#: Lines of an order as crumbs, without the JSON between.
CRUMBS = f"""l0 as (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) as z from lineitem
), l1 as (
  select l_orderkey as id, o_orderdate as occurred_at, l_linenumber as pos, cast(l_quantity as integer) as q, l_partkey as part, l_suppkey as supp, l_partkey % 8 as kind
  from l0 join orders on o_orderkey = l_orderkey where z = 1 and l_orderkey % 50 <> 7 and o_orderdate >= {SINCE}
), cr as (
  select *, ['sql', 'sql', 'cache', 'deprecation', 'rack_attack', 'action_cable', 'active_storage', 'llm'][kind + 1] as c,
    case when q % 4 <> 0 then cast(q as double) end as d,
    case kind when 0 then 'SELECT * FROM parts WHERE id = ' || (part % 7) || ' AND name = ''n' || supp || ''''
      when 1 then 'SELECT * FROM suppliers WHERE id IN (' || supp || ', ' || part || ')'
      when 2 then case when q % 3 = 0 then 'cache write: k' else 'cache read: k' end || (part % 5)
      when 3 then case when q % 9 = 0 then '' else 'old call ' || (part % 6) end
      when 4 then 'throttle ' || (supp % 4) when 5 then 'cable' when 6 then 'storage' else 'chat ' || (part % 3) end as m
  from l1
)"""
SEEN = "count(distinct id) as errors, max(occurred_at) as last_seen"


def on_crumbs(name: str, plan: Callable[..., DataFrame], sql: str) -> None:
    ENTRIES[name] = (lambda spark, d: plan(driver.breadcrumb_logs(spark, d), F.lit(CLOCK).cast("timestamp_ntz"), DAYS), f"with {CRUMBS} {sql}")


on_crumbs("e1_deprecations", crumbs.deprecations, f"select m as message, case when q % 2 = 0 then 'file' || (supp % 3) || '.rb' else 'Unknown' end as source, count(*) as n, {SEEN} from cr where c = 'deprecation' and m <> '' group by 1, 2")
PRINT = "case kind when 0 then 'SELECT * FROM parts WHERE id = ? AND name = ?' else 'SELECT * FROM suppliers WHERE id IN (?)' end"
QUERIES = f"nq as (select id, occurred_at, {PRINT} as fingerprint, count(*) as n, {rnd('sum(coalesce(d, 0.0))', 2)} as total_ms, arg_min(m, pos) as sample from cr where c = 'sql' group by 1, 2, 3 having count(*) >= 3)"
on_crumbs("e2_repeated_queries", crumbs.repeated_queries, f", {QUERIES} select * from nq")
on_crumbs("e3_repeated_query_summary", crumbs.repeated_query_summary, f", {QUERIES} select fingerprint, cast(sum(n) as bigint) as n, count(*) as errors, {rnd('sum(total_ms)', 2)} as total_ms, max(occurred_at) as last_seen from nq group by 1")
on_crumbs("e4_cache_health", crumbs.cache_health, f", a as (select id, count(*) filter (q % 3 <> 0) as reads, count(*) filter (q % 3 = 0) as writes, count(*) filter (q % 3 = 1) as hits, count(*) filter (q % 3 = 2) as misses, {rnd('sum(coalesce(d, 0.0))', 1)} as total_ms, arg_max(m, (d, -pos)) filter (d is not null) as slowest, max(d) as slowest_ms from cr where c = 'cache' group by 1) select *, case when hits + misses <> 0 then {rnd('(hits * 100.0 / (hits + misses))', 1)} end as hit_rate from a")
on_crumbs("e6_cable", crumbs.cable, f"select case when q % 5 <> 0 then 'Room' || (supp % 3) else 'Unknown' end as channel, count(*) as n, count(*) filter (q % 4 = 0) as actions, count(*) filter (q % 4 = 1) as transmissions, count(*) filter (q % 4 = 2) as subscriptions, count(*) filter (q % 4 = 3) as rejections, {SEEN} from cr where c = 'action_cable' group by 1")
on_crumbs("e7_storage", crumbs.storage, f"select case when q % 6 <> 0 then 'S' || (supp % 2) else 'Unknown' end as service, count(*) as n, count(*) filter (q % 6 = 0) as uploads, count(*) filter (q % 6 in (1, 2)) as downloads, count(*) filter (q % 6 in (3, 4)) as deletes, count(*) filter (q % 6 = 5) as exists, {rnd('avg(case when d > 0 then d end)', 2)} as avg_ms, max(case when d > 0 then d end) as max_ms, {SEEN} from cr where c = 'active_storage' group by 1")
on_crumbs("e8_rate_limits", crumbs.rate_limits, f"select 'rule' || (supp % 4) as rule, count(*) as n, count(distinct part % 9) as discriminators, count(distinct q % 4) as paths, arg_min(case when q % 2 = 0 then 'throttle' else 'blocklist' end, (id, pos)) as match_type, arg_min('/p' || (q % 4), (id, pos)) as first_path, {SEEN} from cr where c = 'rack_attack' group by 1")
LLM = "lm as (select id, occurred_at, 'p' || (part % 2) as provider, ['gpt-4o', 'o1-mini', 'none'][part % 3 + 1] as model, q % 4 >= 2 as failed, case when q % 7 <> 0 then cast(part * 3 as double) end as tin, cast(q * 5 as double) as tout, case when q > 0 then cast(q * 11 as double) end as took, case when q % 2 = 0 then cast('0.00' || q as double) end as cost, case when q % 4 >= 2 then 'E' || (supp % 2) end as error_class from cr where c = 'llm')"
RATE = "{0} * 100.0 / {1}"
on_crumbs("e9_llm_health", crumbs.llm_health, f""", {LLM}, a as (select provider, model, count(*) as calls, cast(0 as bigint) as tool_calls, count(*) filter (failed) as failed, count(*) as attempts, {rnd('avg(tin)')} as avg_in, {rnd('avg(tout)')} as avg_out, {rnd('avg(took)', 2)} as avg_ms, {rnd('coalesce(sum(cost), 0.0)', 4)} as cost_usd, {SEEN} from lm group by 1, 2),
t as (select provider, model, error_class, count(*) as k from lm where failed group by 1, 2, 3), u as (select provider, model, arg_min(error_class, (-k, error_class)) as top_error, max(k) as top_error_count from t group by 1, 2),
b as (select *, {rnd('(failed * 100.0 / attempts)', 2)} as error_rate from a left join u using (provider, model))
select *, case when error_rate >= 10 then 'danger' when error_rate >= 5 then 'warning' else 'success' end as severity from b""")
on_crumbs("e10_llm_totals", crumbs.llm_totals, f", {LLM} select count(*) as attempts, count(*) filter (failed) as failed, {rnd('coalesce(sum(cost), 0.0)', 4)} as cost_usd, count(distinct id) as errors, count(distinct (provider, model)) as models, {rnd('(count(*) filter (failed) * 100.0 / count(*))', 2)} as error_rate from lm")
on_crumbs("e11_llm_per_error", crumbs.llm_per_error, f", {LLM} select id, count(*) as calls, cast(0 as bigint) as tool_calls, count(*) filter (failed) as failed, coalesce(sum(tin), 0.0) as tokens_in, sum(tout) as tokens_out, coalesce(sum(took), 0.0) as total_ms, {rnd('coalesce(sum(cost), 0.0)', 6)} as cost_usd from lm group by 1")
on_crumbs("g6_last_crumbs", lambda logs, as_of, n: crumbs.last_crumbs(crumbs.crumbs(logs, as_of, n).select("id", "pos", "c"), "id", ["pos"], 3).select("id", "c", "at"), ', a as (select id, c, row_number() over (partition by id order by pos desc) as back, count(*) over (partition by id) as k, row_number() over (partition by id order by pos) as f from cr) select id, c, cast(f - greatest(k - 3, 0) as integer) as "at" from a where back <= 3')
on_crumbs("f33_tables_of_queries", lambda logs, as_of, n: crumbs.crumbs(logs, as_of, n, "sql").groupBy(text.sql_table(F.col("m")).alias("table_name")).agg(F.count("*").alias("n")), "select case kind when 0 then 'parts' else 'suppliers' end as table_name, count(*) as n from cr where c = 'sql' group by 1")


def _costs(logs: DataFrame, as_of, n: int) -> DataFrame:
    m = F.col("meta")
    rows = crumbs.crumbs(logs, as_of, n, "llm").select(m["model"].alias("model"), m["input_tokens"].try_cast("bigint").alias("i"), m["output_tokens"].try_cast("bigint").alias("o"))
    return rows.select("model", text.llm_cost(F.col("model"), F.col("i"), F.col("o")).alias("cost")).groupBy("model").agg(F.count("cost").alias("priced"), numbers.round_half_up(F.sum("cost"), 4).alias("cost"))


on_crumbs("f27_llm_costs", _costs, f", {LLM}, a as (select model, case model when 'gpt-4o' then {rnd('((coalesce(tin, 0) * 2.5 + tout * 10.0) / 1e6)', 6)} when 'o1-mini' then {rnd('((coalesce(tin, 0) * 3.0 + tout * 12.0) / 1e6)', 6)} end as cost from lm) select model, count(cost) as priced, {rnd('sum(cost)', 4)} as cost from a group by 1")

HEALTH = "hl as (select event_id as id, cast(json_extract_string(props, '$.k') as bigint) as k, event_id as i from events where event_id % 40 <> 11)"


def on_health(name: str, plan: Callable[..., DataFrame], sql: str) -> None:
    ENTRIES[name] = (lambda spark, d: plan(driver.health_logs(spark, d), driver.as_of(), 60), f"with {HEALTH} {sql}")


QUEUES = {"enqueued": ("k * 2", None, None), "processed": ("k * 10", None, None), "failed": ("i % 17", "i % 13", None), "dead": ("i % 4", None, None), "scheduled": ("k % 9", "k % 6", None), "retry": ("k % 3", None, None), "workers": ("4", None, None), "ready": (None, "k % 8", None), "claimed": (None, "i % 5", None), "blocked": (None, "i % 2", None), "queued": (None, None, "k % 12"), "errored": (None, None, "i % 7"), "finished": (None, None, "k * 3")}
on_health("e12_job_queues", crumbs.job_queues, "select id, ['sidekiq', 'solid_queue', 'good_job'][i % 4 + 1] as adapter, " + ", ".join("cast(case " + " ".join(f"when i % 4 = {j} then {x}" for j, x in enumerate(v) if x) + f" end as bigint) as {c}" for c, v in QUEUES.items()) + " from hl where i % 4 <> 3")
on_health("e13_pools", crumbs.pools, f"select id, 5 + k % 5 as size, k % 5 as busy, i % 3 as dead, k % 4 as idle, i % 6 as waiting, {rnd('((k % 5) * 100.0 / (5 + k % 5))', 1)} as utilization, k % 5 + i % 3 + i % 6 as stress from hl")


# over texts
def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("error_type"), F.col("text").alias("message"), F.col("lang").alias("platform"))


ENTRIES["b6_text_search"] = (lambda spark, d: _documents(spark, d).filter(text.text_matches("the%of", F.col("message"), F.col("error_type"))).groupBy("platform").agg(F.count("*").alias("n")), "select lang as platform, count(*) as n from documents where lower(text) like '%the%of%' or lower(source) like '%the%of%' group by 1")
ENTRIES["b5_token_search"] = (lambda spark, d: _documents(spark, d).filter(text.token_matches("the of", F.col("message"))).select("id"), r"select doc_id as id from documents where list_contains(string_split_regex(lower(text), '\W+'), 'the') and list_contains(string_split_regex(lower(text), '\W+'), 'of')")
ENTRIES["f1_truncated"] = (lambda spark, d: _documents(spark, d).select("id", text.truncate(F.col("message"), 80).alias("message")), "select doc_id as id, case when length(text) > 80 then substr(text, 1, 77) || '...' else text end as message from documents")
ENTRIES["f26_masked_messages"] = (lambda spark, d: _documents(spark, d).select("id", F.sha2(text.masked_message(F.col("message")), 256).alias("digest")), r"select doc_id as id, sha256(regexp_replace(regexp_replace(text, '\b(\w*(?:" + "|".join(text.SENSITIVE) + r")\w*)=\S+', '\1=[FILTERED]', 'gi'), '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '[FILTERED]', 'g')) as digest from documents")


# similarity over made-up back traces
def _traced(spark: SparkSession, d: str) -> DataFrame:
    logs = driver.error_logs(spark, d)
    n = lambda m: (F.col("k") % m).cast("string")
    frame = lambda i, m: F.concat(F.lit(f"/srv/app/models/m{i}_"), n(m), F.lit(".rb:10:in `run"), n(m), F.lit("'"))
    trace = F.concat_ws("\n", frame(1, 3), frame(2, 4), frame(3, 5))
    return logs.withColumn("backtrace", trace).withColumn("backtrace_signature", text.backtrace_signature(F.col("backtrace")))


FRAME = "'m{0}_' || (k % {1}) || '.rb:run' || (k % {1})"
TRACED = "[" + ", ".join(FRAME.format(i, m) for i, m in ((1, 3), (2, 4), (3, 5))) + "]"


def _similar() -> str:
    from faultlens.catalog import LOGS

    norm = r"trim(regexp_replace(replace(lower(regexp_replace(message, '0x[0-9a-f]+', '__HEX__', 'g')), '__hex__', '§'), '\d+', 'n', 'g'))"
    return f"""with {LOGS}, t as (select *, {TRACED} as fr, replace({norm}, '§', '0xhex') as msg from logs), o as (select * from t where id = 17),
r as (select t.*, t.fr = o.fr as b1, t.error_type = o.error_type as b2,
  coalesce(t.platform = o.platform and regexp_extract(o.error_type, '^([A-Z][a-z]+)', 1) <> '' and starts_with(t.error_type, regexp_extract(o.error_type, '^([A-Z][a-z]+)', 1)), false) as b3 from t, o where t.id <> 17),
c as (select * from (select *, 1 as bl from r where b1 order by id limit 50) union all select * from (select *, 2 from r where b2 and not b1 order by id limit 30) union all select * from (select *, 3 from r where b3 and not b1 and not b2 order by id limit 20)),
k as (select count(*) filter (bl = 1) as n1, count(*) filter (bl = 2) as n2 from c),
s as (select c.id, c.error_type, case when c.platform is not null and o.platform is not null and c.platform <> o.platform then 0.0 else
  0.7 * len(list_intersect(c.fr, o.fr)) / len(list_distinct(list_concat(c.fr, o.fr))) + 0.3 * case when c.msg = o.msg then 1.0 else 1 - levenshtein(c.msg, o.msg) * 1.0 / greatest(length(c.msg), length(o.msg)) end end as x
  from c, o, k where bl = 1 or (bl = 2 and n1 < 20) or (bl = 3 and n1 < 20 and n1 + n2 < 20))
select id, error_type, {rnd('x', 3)} as similarity from s where {rnd('x', 3)} >= 0.6 order by similarity desc, id limit 10"""


ENTRIES["h9_similar_errors"] = (lambda spark, d: similar.similar_errors(_traced(spark, d), 17), _similar())
SIGNATURE = "substr(sha256(array_to_string(list_sort([" + ", ".join(f"'m{i}_' || (k % {m}) || '.rb'" for i, m in ((1, 3), (2, 4), (3, 5))) + "]), '|')), 1, 16)"
ENTRIES["f17_signatures"] = (lambda spark, d: _traced(spark, d).groupBy("backtrace_signature").agg(F.count("*").alias("n")), f"with e0 as (select cast(json_extract_string(props, '$.k') as integer) as k from events) select {SIGNATURE} as backtrace_signature, count(*) as n from e0 group by 1")
#: Paths of every category, with the short paths that the frame parser gives them.
PATHS = [
    ("/srv/app/models/user.rb", "app", "app/models/user.rb"),
    ("/srv/app/x/app/models/order.rb", "app", "app/models/order.rb"),
    ("/srv/lib/tasks/sync.rb", "app", "lib/tasks/sync.rb"),
    ("/home/u/.gem/gems/rack-test-3.1/lib/rack.rb", "gem", "rack/lib/rack.rb"),
    ("/bundle/gems/puma-6.0.2/lib/puma/server.rb", "gem", "puma/lib/puma/server.rb"),
    ("/opt/vendor/bundle/cache/thing.rb", "gem", "thing.rb"),
    ("/opt/ruby/activerecord-7.1/base.rb", "framework", "base.rb"),
    ("/usr/lib/ruby/3.4.0/net/http.rb", "ruby_core", "http.rb"),
    ("config.ru", "ruby_core", "config.ru"),
]


def _frames(spark: SparkSession, d: str):
    paths = F.array(*[F.lit(path) for path, *_ in PATHS])
    line = F.concat(F.element_at(paths, (F.col("k") % len(PATHS) + 1).cast("int")), F.lit(":12:in `run'"))
    return driver.error_logs(spark, d).select(F.regexp_extract(line, r"^(.+?):\d+", 1).alias("path"))


ENTRIES["f20_frames_by_category"] = (
    lambda spark, d: _frames(spark, d).groupBy(text.frame_category(F.col("path")).alias("category"), text.frame_path(F.col("path")).alias("path")).agg(F.count("*").alias("n")),
    "with p(place, category, path) as (values " + ", ".join(f"({i}, '{category}', '{short}')" for i, (_, category, short) in enumerate(PATHS)) + f") select category, path, count(*) as n from (select cast(json_extract_string(props, '$.k') as integer) % {len(PATHS)} as place from events) join p using (place) group by 1, 2",
)


def _requests(spark: SparkSession, d: str):
    """Parameters and causes with sensitive values at several depths."""
    k = (F.col("k") % 7).cast("string")
    params = F.concat(F.lit('{"id":'), k, F.lit(',"user":{"name":"n'), k, F.lit('","API_Key":"a'), k, F.lit('","list":[{"pin":1},{"age":'), k, F.lit('}]},"password":{"old":"x"},"note":null}'))
    causes = F.concat(F.lit('[{"class_name":"E","message":"token=t'), k, F.lit(' for card 4111 1111 1111 1111"},{"class_name":"F","message":"no '), k, F.lit('"}]'))
    return driver.error_logs(spark, d).select(params.alias("params"), causes.alias("causes"))


ENTRIES["f26_masked_json"] = (
    lambda spark, d: _requests(spark, d).select(text.masked_json(F.col("params")).alias("params"), text.masked_causes(F.col("causes")).alias("causes")).groupBy("params", "causes").agg(F.count("*").alias("n")),
    """with e0 as (select cast(cast(json_extract_string(props, '$.k') as integer) % 7 as varchar) as k from events)
select '{"id":' || k || ',"user":{"name":"n' || k || '","API_Key":"[FILTERED]","list":[{"pin":"[FILTERED]"},{"age":' || k || '}]},"password":"[FILTERED]","note":null}' as params,
  '[{"class_name":"E","message":"token=[FILTERED] for card [FILTERED]"},{"class_name":"F","message":"no ' || k || '"}]' as causes, count(*) as n from e0 group by k""",
)
