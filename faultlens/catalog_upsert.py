"""The queries over the upsert of errors into groups, with the same in SQL: one occurrence after another, by recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalog import LOGS
from faultlens.catalog_ingest import CUT
from faultlens.operators import upsert
from faultlens.operators.grouping import MILESTONES
from faultlens.sources import driver

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored groups, and the events after ``CUT``: occurrences, and a change at every tenth."""
    logs, cut = driver.error_logs(spark, d), F.lit(CUT).cast("timestamp_ntz")
    new = logs.filter(F.col("occurred_at") >= cut)
    order = F.lpad(F.col("id").cast("string"), 12, "0")
    context = lambda what: F.to_json(F.struct(order.alias("session_id"), F.lit(what).alias("request_id"), "user_id", "error_type", "message"))
    own = F.get_json_object("context", "$.session_id").cast("long") % 30
    kind = F.when(own == 0, "resolve").when(own == 10, "mute").otherwise("wont_fix")
    later = new.filter(F.col("id") % 10 == 0)
    changes = upsert.as_events(later, context("c")).withColumn("kind", kind).withColumn("at_us", F.col("at_us") + 1)
    return upsert.as_groups(logs.filter(F.col("occurred_at") < cut)), upsert.as_events(new, context("r")).union(changes)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return upsert.outcomes(*_parts(spark, d))


_TIMES = lambda *names: [F.timestamp_micros(us).cast("timestamp_ntz").alias(n) for us, n in names]
DAY, PAUSE = 24 * 3600 * 10**6, 5 * 60 * 10**6
# a group as a struct, and the rules of one step
_G = "{'id': cast({id} as bigint), 'first': {first}, 'last': {last}, 'n': {n}, 'resolved': {resolved}, 'status': {status}, 'muted': {muted}, 'reopened': {reopened}}"


def _g(**kw: str) -> str:
    out = _G
    for k, v in kw.items():
        out = out.replace("{" + k + "}", v)
    return out


_STORED = _g(id="id", first="epoch_us(occurred_at)", last="epoch_us(last_seen_at)", n="cast(occurrence_count as bigint)", resolved="resolved", status="status", muted="muted", reopened="epoch_us(reopened_at)")
_OPENED = _g(id="hit", first="us", last="us", n="cast(1 as bigint)", resolved="false", status="'new'", muted="false", reopened="cast(null as bigint)")
_COUNTED = _g(id="g.id", first="g.first", last="greatest(g.last, us)", n="g.n + 1", resolved="g.resolved and kind <> 'reopened'", status="case when kind = 'reopened' then 'new' else g.status end", muted="g.muted", reopened="case when kind = 'reopened' then us else g.reopened end")
_CHANGED = _g(id="g.id", first="g.first", last="g.last", n="g.n", resolved="g.resolved or kind = 'resolve'", status="case kind when 'resolve' then 'resolved' when 'wont_fix' then 'wont_fix' else g.status end", muted="g.muted or kind = 'mute'", reopened="g.reopened")
_LAST = lambda gs: f"list_sort(list_transform({gs}, lambda g: {{'last': g.last, 'id': g.id}}), 'DESC')[1].id"
WALK = f"""{LOGS}, st as (
  select application_id, error_hash, list({_STORED}) as gs from logs where occurred_at < timestamp '{CUT}' group by 1, 2
), nw as (
  select application_id, error_hash, epoch_us(occurred_at) as us, 'occurrence' as event, id, user_id from logs where occurred_at >= timestamp '{CUT}'
  union all select application_id, error_hash, epoch_us(occurred_at) + 1, case id % 30 when 0 then 'resolve' when 10 then 'mute' else 'wont_fix' end, id, user_id from logs where occurred_at >= timestamp '{CUT}' and id % 10 = 0
), ev as materialized (
  select *, row_number() over (partition by application_id, error_hash order by us, event, id) as pos from nw
), walk as (
  select application_id, error_hash, cast(0 as bigint) as pos, coalesce(gs, []) as gs, cast(null as bigint) as hit, cast(null as varchar) as kind, cast(null as bigint) as us,
    cast(null as bigint) as user_id, false as notify, cast(null as bigint) as notified
  from (select distinct application_id, error_hash from ev) k left join st using (application_id, error_hash)
  union all
  select application_id, error_hash, pos, gs, hit, kind, us, user_id, notify, case when notify then us else notified end
  from (
    select *, case when kind not in ('created', 'recurred', 'reopened') then false else not list_filter(gs, lambda g: g.id = hit)[1].muted and case kind when 'created' then true
      when 'reopened' then notified is null or us > notified + {PAUSE} else list_filter(gs, lambda g: g.id = hit)[1].n in {MILESTONES} end end as notify
    from (
      select application_id, error_hash, pos, hit, kind, us, user_id, notified,
        case when kind = 'created' then list_append(gs, {_OPENED}) when kind in ('recurred', 'reopened') then list_transform(gs, lambda g: case when g.id = hit then {_COUNTED} else g end)
          else list_transform(gs, lambda g: case when g.id = hit then {_CHANGED} else g end) end as gs
      from (
        select *, case when event <> 'occurrence' then event when fresh is not null then 'recurred' when closed is not null then 'reopened' else 'created' end as kind,
          case when event <> 'occurrence' then newest else coalesce(fresh, closed, ('0x' || substr(sha256(application_id || '|' || error_hash || '|' || us), 1, 15))::bigint) end as hit
        from (
          select w.application_id, w.error_hash, e.pos, w.gs, e.us, e.user_id, e.event, w.notified,
            {_LAST(f"list_filter(w.gs, lambda g: not g.resolved and g.first >= e.us - {DAY})")} as fresh, {_LAST("list_filter(w.gs, lambda g: g.status in ('resolved', 'wont_fix'))")} as closed, {_LAST("w.gs")} as newest
          from walk w join ev e on e.application_id = w.application_id and e.error_hash = w.error_hash and e.pos = w.pos + 1
        )
      )
    )
  )
)"""
SQL = f"with recursive {WALK} "
_NTZ = lambda us: f"make_timestamp({us})"

ENTRIES["i3_occurrence_append"] = (
    lambda spark, d: _outcomes(spark, d).filter(F.col("outcome").isin("created", "recurred", "reopened")).select("error_log_id", *_TIMES(("at_us", "occurred_at")), F.get_json_object("context", "$.user_id").cast("long").alias("user_id")),
    SQL + f"select hit as error_log_id, {_NTZ('us')} as occurred_at, user_id from walk where kind in ('created', 'recurred', 'reopened')",
)
ENTRIES["i1_upserted_groups"] = (
    lambda spark, d: upsert.latest(_outcomes(spark, d)).select("application_id", "error_hash", "id", "occurrence_count", "resolved", "status", "muted", *_TIMES(("first_us", "occurred_at"), ("last_us", "last_seen_at"), ("reopened_us", "reopened_at"))),
    SQL
    + f""", l as (select application_id, error_hash, hit, max(pos) as pos from walk where hit is not null group by 1, 2, 3), x as (select l.*, list_filter(gs, lambda g: g.id = l.hit)[1] as g from l join walk using (application_id, error_hash, pos))
select application_id, error_hash, hit as id, g.n as occurrence_count, g.resolved as resolved, g.status as status, g.muted as muted, {_NTZ('g.first')} as occurred_at, {_NTZ('g.last')} as last_seen_at, {_NTZ('g.reopened')} as reopened_at from x""",
)
ENTRIES["i4_upsert_notifications"] = (
    lambda spark, d: _outcomes(spark, d).filter("notify").select("application_id", "error_hash", "error_log_id", "outcome", *_TIMES(("at_us", "at")), "occurrence_count"),
    SQL + f"select application_id, error_hash, hit as error_log_id, kind as outcome, {_NTZ('us')} as at, list_filter(gs, lambda g: g.id = hit)[1].n as occurrence_count from walk where notify",
)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The joined path: two batches written, the second one twice, and the groups that were touched read back with how often each occurred."""
    from faultlens.sources.folders import shared_path
    from faultlens.streaming.store import Store

    groups, events = _parts(spark, d)
    store = Store(spark, shared_path(spark, "ingest"))
    cut = F.unix_micros(F.lit("2024-01-30 00:00:00").cast("timestamp"))
    store.write(upsert.outcomes(groups, events.filter(F.col("at_us") < cut)), 0)
    for _ in range(2):
        store.write(upsert.outcomes(store.groups(groups), events.filter(F.col("at_us") >= cut)), 1)
    seen = store.table("occurrences").groupBy(F.col("error_log_id").alias("id")).agg(F.count("*").alias("occurrences"))
    return store.groups().join(seen, "id", "left").select("application_id", "error_hash", "id", "occurrence_count", "resolved", "status", "muted", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


ENTRIES["i2_stored_batches"] = (
    _stored,
    SQL
    + """, l as (select application_id, error_hash, hit, max(pos) as pos, count(*) filter (kind in ('created', 'recurred', 'reopened')) as occurrences from walk where hit is not null group by 1, 2, 3), x as (select l.*, list_filter(gs, lambda g: g.id = l.hit)[1] as g from l join walk using (application_id, error_hash, pos))
select application_id, error_hash, hit as id, g.n as occurrence_count, g.resolved as resolved, g.status as status, g.muted as muted, occurrences from x""",
)
