"""Every query of the error analytics over the driver's tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import numbers, severity, text
from faultlens.operators import filters, grouping, rangejoin, sequences, windows, workflow
from faultlens.plans import correlation, crumbs, dashboard, lifecycle, platforms
from faultlens.sources import driver

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {}
AS_OF = f"timestamp '{driver.AS_OF}'"


def rnd(x: str, n: int = 0) -> str:
    return f"(sign({x}) * floor(abs({x}) * {10**n}.0 + 0.5) / {10**n}.0)"


def quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


SEVERITY = "case " + " ".join(f"when error_type in ({quoted(v)}) then '{k}'" for k, v in severity.LEVELS.items()) + " else 'low' end"
TYPE = "list_extract(case event_type " + " ".join(f"when '{t}' then [{quoted(v)}]" for t, v in driver.TYPES.items()) + " end, k % 3 + 1)"
LOGS = f"""e0 as (
  select *, cast(json_extract_string(props, '$.k') as integer) as k, cast(extract(day from ts) as integer) as dom from events
), logs as (
  select event_id as id, ts as occurred_at, user_id % 3 + 1 as application_id, {TYPE} as error_type,
    case k % 5 when 0 then 'iOS' when 1 then 'Android' when 2 then 'API' when 3 then 'Web' end as platform,
    case when k % 10 <> 0 then user_id end as user_id, cast(1 + (k % 40) * (event_id % 4) as integer) as occurrence_count,
    k % 3 = 0 as resolved, case when k % 3 = 0 then ts + to_minutes((1 + k) * 37) end as resolved_at,
    case when k = 98 then null when k = 99 then '' else '1.' || cast(dom // 5 as varchar) || '.0' end as app_version,
    case when k <> 97 then 'sha' || cast(dom % 7 as varchar) end as git_sha, {TYPE} || '-' || cast(user_id % 20 as varchar) as error_hash,
    case when k % 3 = 0 then 'resolved' when k % 4 = 0 then 'new' when k % 4 = 1 then 'in_progress' when k % 4 = 2 then 'investigating' else 'wont_fix' end as status,
    case when event_id % 5 = 0 then 'dev' || cast(user_id % 3 as varchar) end as assigned_to,
    case when event_id % 7 = 0 then ts + interval 240 hours end as snoozed_until, event_id % 11 = 0 as muted,
    case when k % 13 = 0 then ts + interval 1 hour end as reopened_at, cast(event_id % 5 as integer) as priority_level,
    ts - to_hours(k * 4) as first_seen_at, ts + to_hours(k % 50) as last_seen_at,
    {TYPE} || ' for user ' || cast(user_id as varchar) || ' at 0x' || lower(to_hex(event_id)) || ' id: ' || cast(k as varchar) as message, k
  from e0
)"""
OCCURRENCES = "occ as (select event_id as id, list_position(['error', 'click', 'view', 'purchase', 'signup'], event_type) * 10 + user_id % 4 as error_log_id, ts as occurred_at, user_id from events)"
HOURS = "date_diff('microsecond', occurred_at, resolved_at) / 1e6 / 3600"


def since(n: float) -> str:
    return f"occurred_at >= {AS_OF} - interval {int(n * 24)} hour"


def on_logs(name: str, plan: Callable[..., DataFrame], sql: str | None, *args, clock: bool = True, **kw) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = driver.error_logs(spark, sf_dir)
        out = plan(logs, driver.as_of(), *args, **kw) if clock else plan(logs, *args, **kw)
        # dates as text, which every engine shows alike
        return out.withColumns({c: F.col(c).cast("string") for c, t in out.dtypes if t == "date"})

    ENTRIES[name] = (query, None if sql is None else f"with {LOGS} {sql}")


def change(now: str, before: str) -> str:
    return f"case when {before} <> 0 then {rnd(f'(({now} - {before}) * 100.0 / {before})', 1)} when {now} = 0 then 0.0 else 100.0 end"


def pct(a: str, b: str, n: int = 1, otherwise: str = "0.0") -> str:
    return f"case when {b} <> 0 then {rnd(f'({a} * 100.0 / {b})', n)} else {otherwise} end"


on_logs("d3_top_types", dashboard.top_types, f"select error_type, count(*) as n, {SEVERITY} as severity from logs where {since(7)} group by error_type order by n desc, error_type limit 10")
on_logs("d1_dashboard_counts", dashboard.counts, f"""
, a as (select count(*) filter (occurred_at >= date_trunc('day', {AS_OF})) as total_today,
  count(*) filter (occurred_at >= date_trunc('day', {AS_OF}) - interval 1 day and occurred_at < date_trunc('day', {AS_OF})) as total_yesterday,
  count(*) filter ({since(7)}) as total_week, count(*) filter ({since(30)}) as total_month, count(*) filter (not resolved) as unresolved,
  count(*) filter (resolved) as resolved, count(*) filter (reopened_at is not null) as reopened,
  count(distinct case when occurred_at >= date_trunc('day', {AS_OF}) then user_id end) as users_today,
  count(distinct case when occurred_at >= date_trunc('day', {AS_OF}) - interval 1 day and occurred_at < date_trunc('day', {AS_OF}) then user_id end) as users_yesterday,
  avg(case when resolved and resolved_at >= {AS_OF} - interval 30 day then {HOURS} end) as h from logs
), b as (select *, {change('total_today', 'total_yesterday')} as trend_percentage from a)
select * exclude (h), users_today - users_yesterday as users_change, least({rnd("(total_today / 24.0)", 1)}, 100.0) as error_rate,
  case when trend_percentage > 10 then 'increasing' when trend_percentage < -10 then 'decreasing' else 'stable' end as trend_direction,
  {rnd('h', 2)} as avg_resolution_hours from b""")
on_logs("d2_by_platform", dashboard.by_platform, "select platform, count(*) as n from logs group by platform", clock=False)
on_logs("d4_daily_trend", dashboard.daily_trend, f"""
select cast(cast(d as date) as varchar) as day, count(id) as n from generate_series(date '2024-01-23', date '2024-01-30', interval 1 day) g(d)
left join (select * from logs where {since(7)}) l on cast(l.occurred_at as date) = cast(d as date) group by 1""")
on_logs("d5_severity_histogram", dashboard.severity_histogram, "select " + ", ".join(f"count(*) filter ({SEVERITY} = '{s}') as {s}" for s in ("critical", "high", "medium", "low")) + f" from logs where {since(7)}")
TRUNC = lambda c, n: f"case when length({c}) > {n} then substr({c}, 1, {n - 3}) || '...' else {c} end"
on_logs("d11_top_by_impact", dashboard.top_by_impact, f"select id, error_type, {TRUNC('message', 80)} as message, case when user_id is not null then 1 else 0 end as users, cast(case when user_id is not null then occurrence_count else 0 end as bigint) as impact from logs where {since(7)} order by impact desc, id limit 6")
on_logs("d13_statistics", dashboard.statistics, f"select cast(cast(occurred_at as date) as varchar) as day, count(*) as n, count(*) filter (not resolved) as unresolved from logs where {since(30)} group by 1")
on_logs("d14_daily_series", dashboard.daily_series, f"""
, c as (select cast(occurred_at as date) as day, count(*) as n from logs where {since(30)} group by 1)
select cast(cast(s.day as date) as varchar) as day, coalesce(n, 0) as n from (select unnest(generate_series((select min(day) from c), (select max(day) from c), interval 1 day)) as day) s left join c on c.day = cast(s.day as date)""")
on_logs("d15_by_hour", dashboard.by_hour, f"select cast(h as integer) as hour, count(id) as n from range(24) r(h) left join (select * from logs where {since(30)}) l on extract(hour from l.occurred_at) = h group by 1")
on_logs("d16_top_users", dashboard.top_users, f"select user_id, 'User #' || cast(user_id as varchar) as email, count(*) as n from logs where {since(30)} and user_id is not null group by user_id order by n desc, user_id limit 10")
on_logs("d17_resolution", dashboard.resolution, f"select count(*) filter (application_id = 1) as total, {pct('count(*) filter (resolved)', 'count(*) filter (application_id = 1)')} as resolution_rate, count(*) filter (application_id = 1 and platform in ('iOS', 'Android')) as mobile_errors, count(*) filter (application_id = 1 and (platform is null or platform = 'API')) as api_errors from logs where {since(30)}", application=1)

JOINED = lambda c: f"coalesce(string_agg(distinct {c}, ',' order by {c}), '')"
PER = f"count(*) as n, count(distinct error_type) as types, count(*) filter ({SEVERITY} = 'critical') as critical"
on_logs("d20_by_version", correlation.by_version, f"select app_version, {PER}, {JOINED('platform')} as platforms, min(occurred_at) as first_seen, max(occurred_at) as last_seen from logs where {since(30)} and app_version is not null group by 1")
on_logs("d21_by_sha", correlation.by_sha, f"select git_sha, {PER}, {JOINED('app_version')} as versions, min(occurred_at) as first_seen, max(occurred_at) as last_seen from logs where {since(30)} and git_sha is not null group by 1")
on_logs("d22_problematic_releases", correlation.problematic_releases, f", v as (select app_version, {PER} from logs where {since(30)} and app_version is not null group by 1), m as (select avg(n) as mean from v) select app_version, n, critical, {rnd('((n - mean) / mean * 100)', 1)} as deviation from v, m where n > mean * 1.1", factor=1.1)
on_logs("d23_multi_error_users", correlation.multi_error_users, f"select user_id, count(distinct error_type) as types, count(*) as total, {JOINED('error_type')} as error_types from logs where {since(30)} and user_id is not null group by 1 having count(distinct error_type) >= 2")
on_logs("c9_user_overlap", correlation.user_overlap, f", u as (select user_id, bool_or(error_type = 'TypeError') as a, bool_or(error_type = 'LoadError') as b from logs where {since(2)} and error_type in ('TypeError', 'LoadError') and user_id is not null group by 1), c as (select count(*) filter (a) as users_a, count(*) filter (b) as users_b, count(*) filter (a and b) as overlap from u) select *, {pct('overlap', 'least(users_a, users_b)')} as percentage from c", "TypeError", "LoadError", n=2)
on_logs("c10_platform_specific", correlation.platform_specific, f", p as (select platform, error_type, count(*) as n from logs where {since(2)} and platform is not null group by 1, 2), t as (select *, row_number() over (partition by platform order by n desc, error_type) as place from p) select t.platform, t.error_type, t.n, coalesce(string_agg(o.platform, ',' order by o.platform), '') as others, count(o.platform) = 0 as platform_specific from t left join p o on o.error_type = t.error_type and o.platform <> t.platform where place <= 5 group by 1, 2, 3", n=2)
on_logs("d24_time_correlated", correlation.time_correlated, f"""
, t as (select distinct error_type from logs where {since(30)}), g as (select error_type, h from t, range(24) r(h)),
c as (select g.error_type, h, cast(count(l.id) as double) as n from g left join (select * from logs where {since(30)}) l on l.error_type = g.error_type and extract(hour from l.occurred_at) = h group by 1, 2),
p as (select a.error_type as type_a, b.error_type as type_b, sum(a.n) as sx, sum(b.n) as sy, sum(a.n * a.n) as sxx, sum(b.n * b.n) as syy, sum(a.n * b.n) as sxy from c a join c b on a.h = b.h and a.error_type < b.error_type group by 1, 2),
q as (select type_a, type_b, case when sx = 0 or sy = 0 or (24 * sxx - sx * sx) * (24 * syy - sy * sy) <= 0 then 0.0 else {rnd('((24 * sxy - sx * sy) / sqrt((24 * sxx - sx * sx) * (24 * syy - sy * sy)))', 3)} end as correlation from p)
select *, case when abs(correlation) >= 0.8 then 'strong' when abs(correlation) >= 0.5 then 'moderate' else 'weak' end as strength from q where correlation > 0.3""", least=0.3)
on_logs("d25_period_comparison", correlation.period_comparison, f", a as (select count(*) filter ({since(7)}) as current, count(*) filter ({since(14)} and not ({since(7)})) as previous from logs), b as (select *, current - previous as change, {change('current', 'previous')} as change_percentage from a) select *, case when change_percentage > 20 then 'increasing_significantly' when change_percentage > 5 then 'increasing' when change_percentage < -20 then 'decreasing_significantly' when change_percentage < -5 then 'decreasing' else 'stable' end as trend from b", n=14)

on_logs("d26_severity_by_platform", platforms.severity_distribution, f"select platform, {SEVERITY} as severity, count(*) as n from logs where {since(7)} group by 1, 2")
RESOLUTION = f"{rnd(f'avg({rnd(HOURS, 2)}) filter (resolved and resolved_at is not null)', 2)}"
on_logs("d27_resolution_by_platform", platforms.resolution_times, f"select a.platform, hours from (select distinct platform from logs where platform is not null) a left join (select platform, {RESOLUTION} as hours from logs where {since(7)} group by 1) b using (platform)")
on_logs("d28_top_by_platform", platforms.top_errors, f"select * from (select platform, id, error_type, {TRUNC('message', 100)} as message, occurrence_count, cast(row_number() over (partition by platform order by occurrence_count desc, id) as integer) as place from logs where {since(7)} and platform is not null) where place <= 10")
STABILITY = f"st as (select platform, {rnd('((0.7 * (1 - n / greatest(most, 1)) + 0.3 * case when coalesce(h, 0) > 0 then 1 - h / slowest else 1.0 end) * 100)', 1)} as score from (select *, max(n) over () as most, max(case when platform is not null then h end) over () as slowest from (select platform, count(*) as n, {RESOLUTION} as h from logs where {since(7)} group by 1)) where platform is not null)"
on_logs("d29_stability", platforms.stability, f", {STABILITY} select platform, score from st")
on_logs("d30_cross_platform", platforms.cross_platform, f", p as (select error_type, platform, sum(occurrence_count) as n from logs where {since(7)} group by 1, 2) select error_type, count(platform) as platforms, cast(sum(n) as bigint) as total, string_agg(platform || '=' || cast(n as varchar), ',' order by platform || '=' || cast(n as varchar)) as by_platform from p group by 1 having count(platform) > 1")
on_logs("d31_daily_by_platform", platforms.daily_trends, f", r as (select * from logs where {since(7)} and platform is not null) select p.platform, cast(cast(d as date) as varchar) as day, count(r.id) as n from (select distinct platform from r) p cross join generate_series(date '2024-01-23', date '2024-01-30', interval 1 day) g(d) left join r on r.platform = p.platform and cast(r.occurred_at as date) = cast(d as date) group by 1, 2")
on_logs("d32_platform_health", platforms.health, f", {STABILITY}, p as (select platform, count(*) as total, count(*) filter ({SEVERITY} = 'critical') as critical, count(*) filter (not resolved) as unresolved, count(*) filter ({since(3.5)}) as now_, count(*) filter (not ({since(3.5)})) as before_ from logs where {since(7)} and platform is not null group by 1) select platform, total, critical, unresolved, {pct('(total - unresolved)', 'total')} as resolution_rate, {pct('(now_ - before_)', 'before_')} as velocity, score as stability, case when score >= 80 and unresolved <= 10 then 'healthy' when score >= 60 and unresolved <= 50 then 'warning' else 'critical' end as status from p join st using (platform)")

VERSIONS = f"r as (select * from logs where {since(30)} and app_version is not null and app_version <> ''), nw as (select v as app_version, count(*) as new_errors from (select error_hash, arg_min(app_version, occurred_at) as v from (select *, row_number() over (partition by error_hash order by occurred_at, id) as z from r) where z = 1 group by 1) group by 1), v as (select app_version, count(*) as n, count(distinct error_type) as types, min(occurred_at) as first_seen, max(occurred_at) as last_seen, {JOINED('git_sha')} as shas from r group by 1), tl as (select app_version, n, types, first_seen, last_seen, shas, coalesce(new_errors, 0) as new_errors, n - lag(n) over o as delta, case when lag(n) over o > 0 then {rnd('((n - lag(n) over o) * 100.0 / lag(n) over o)', 1)} end as delta_percentage, case when n <= avg(n) over () then 'green' when n <= 2 * avg(n) over () then 'yellow' else 'red' end as stability, n > 2 * avg(n) over () as problematic, lead(n) over o is null as current from v left join nw using (app_version) window o as (order by first_seen, app_version))"
on_logs("d33_release_timeline", lifecycle.release_timeline, f", {VERSIONS} select * from tl")
on_logs("d34_release_summary", lifecycle.release_summary, f", {VERSIONS} select count(*) as releases, max(case when current then app_version end) as current_version, {rnd('avg(n)', 1)} as average from tl")
on_logs("d48_release_comparison", lifecycle.release_comparison, f", {VERSIONS}, z as (select *, row_number() over (order by last_seen desc, app_version) as pl from v), w as (select max(app_version) filter (pl = 1) as app_version_now, max(n) filter (pl = 1) as n_now, max(app_version) filter (pl = 2) as app_version_before, max(n) filter (pl = 2) as n_before from z) select *, case when n_before > 0 then {change('n_now', 'n_before')} end as change_percentage from w")
DONE = f"from logs where {since(30)} and resolved and resolved_at is not null"
on_logs("d35_mttr", lifecycle.mttr, f"select count(*) as resolved, coalesce({rnd(f'avg({rnd(HOURS, 2)})', 2)}, 0.0) as mttr_hours, cast(floor(min({HOURS} * 60)) as bigint) as fastest_minutes, {rnd(f'(max({HOURS} * 60) / 60)', 1)} as slowest_hours {DONE}")
on_logs("d36_mttr_by_platform", lifecycle.mttr_by, f"select platform, {rnd(f'avg({HOURS})', 2)} as mttr_hours {DONE} and platform is not null group by 1", "platform")
on_logs("d36_mttr_by_severity", lifecycle.mttr_by, f"select {SEVERITY} as severity, {rnd(f'avg({HOURS})', 2)} as mttr_hours {DONE} group by 1", "severity")
on_logs("d37_mttr_by_week", lifecycle.mttr_by_week, f"select cast(floor(date_diff('microsecond', {AS_OF} - interval 30 day, occurred_at) / 1e6 / 604800) as bigint) as week, count(*) as n, {rnd(f'avg({HOURS})', 2)} as mttr_hours {DONE} group by 1")
on_logs("d39_high_frequency", lifecycle.high_frequency, f"select *, {rnd('''(date_diff('microsecond', first_seen, last_seen) / 1e6 / 86400)''', 0)} as duration_days, last_seen > {AS_OF} - interval 1 day as still_active from (select error_type, cast(sum(occurrence_count) as bigint) as occurrences, min(first_seen_at) as first_seen, max(last_seen_at) as last_seen, count(*) as n from logs where {since(30)} and occurrence_count > 10 group by 1 order by occurrences desc, error_type limit 10)")
on_logs("d40_persistent", lifecycle.persistent, f"select id, error_type, first_seen_at, {rnd(f'''(date_diff('microsecond', first_seen_at, {AS_OF}) / 1e6 / 86400)''', 0)} as age_days from logs where not resolved and first_seen_at < {AS_OF} - interval 7 day order by first_seen_at, id limit 10")
IMPACT = f"im as (select error_type, count(distinct user_id) as users, count(*) as n, arg_max(id, (occurred_at, id)) as latest_id, {TRUNC('arg_max(message, (occurred_at, id))', 120)} as message, {SEVERITY} as severity, {rnd('(count(distinct user_id) * 100.0 / 1000)', 1)} as impact from logs where {since(30)} group by 1 having count(distinct user_id) > 0)"
on_logs("d42_user_impact", lifecycle.user_impact, f", {IMPACT} select * from im", total_users=1000)
on_logs("d43_user_impact_summary", lifecycle.user_impact_summary, f", {IMPACT} select count(*) as types, cast(sum(users) as bigint) as users, arg_min(error_type, (-users, error_type)) as most_impactful from im")
DIGEST = f"select count(*) filter ({since(7)} and occurrence_count <= 1) as new_errors, count(*) filter ({since(7)}) as total, coalesce(cast(sum(occurrence_count) filter ({since(7)}) as bigint), 0) as occurrences, count(*) filter ({since(7)} and resolved) as resolved, count(*) filter ({since(7)} and not resolved) as unresolved, count(*) filter ({since(7)} and {SEVERITY} in ('critical', 'high')) as urgent, count(*) filter (not ({since(7)})) as previous from logs where {since(14)}"
on_logs("d45_digest", lifecycle.digest, f", a as ({DIGEST}) select *, {pct('resolved', 'total')} as resolution_rate, case when previous > 0 then {change('total', 'previous')} end as change_percentage from a", n=7)
on_logs("d45_digest_top", lifecycle.digest_top, f"select error_type, count(*) as n, arg_max(id, (occurred_at, id)) as sample_id from logs where {since(7)} and not resolved group by 1 order by n desc, error_type limit 5", n=7)
on_logs("d45_digest_urgent", lifecycle.digest_urgent, f"select id, error_type, occurred_at from logs where {since(7)} and not resolved and {SEVERITY} in ('critical', 'high') order by occurred_at desc, id limit 5", n=7)
on_logs("d46_filter_options", lifecycle.filter_options, "select distinct name, value from (select 'error_type' as name, error_type as value from logs union all select 'platform', platform from logs union all select 'assigned_to', assigned_to from logs) where value is not null", clock=False)
on_logs("d47_application_stats", lifecycle.application_stats, f"select application_id, count(*) as total, count(*) filter (not resolved) as unresolved, count(*) filter ({since(1)}) as day, count(*) filter ({since(7)}) as week, count(*) filter ({since(30)}) as month from logs group by 1")


def _applications(logs: DataFrame) -> DataFrame:
    apps = logs.sparkSession.range(1, 6).select("id", F.concat(F.lit("app"), F.col("id").cast("string")).alias("name"))
    return lifecycle.applications(apps, logs)


on_logs("c1_applications", _applications, "select 'app' || cast(a as varchar) as name, count(id) as total, count(*) filter (not resolved) as unresolved from range(1, 6) r(a) left join logs on application_id = a group by a", clock=False)
on_logs("a2_window_scan", windows.since, f"select * from logs where {since(3)} and application_id in (1, 2)", 3, application=[1, 2])


def _swallowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = driver.error_logs(spark, sf_dir)
    per = logs.groupBy(F.col("error_type").alias("exception_class"), F.concat(F.lit("file:"), (F.col("k") % 7).cast("string")).alias("raise_location"), F.date_trunc("HOUR", "occurred_at").cast("timestamp_ntz").alias("period_hour")).agg(F.sum(F.col("k") + 1).alias("raise_count"), F.sum(F.when(F.col("k") % 7 < 3, F.col("k") + 1).otherwise(F.col("k") % 20)).alias("rescue_count"), F.max("occurred_at").alias("last_seen_at"), F.max(F.concat(F.lit("file:"), (F.col("k") % 11).cast("string"))).alias("rescue_location"))
    return lifecycle.swallowed(per, driver.as_of())


ENTRIES["d44_swallowed"] = (_swallowed, f"with {LOGS}, s as (select error_type as exception_class, 'file:' || cast(k % 7 as varchar) as raise_location, cast(sum(k + 1) as bigint) as raised, cast(sum(case when k % 7 < 3 then k + 1 else k % 20 end) as bigint) as rescued, max(occurred_at) as last_seen, max('file:' || cast(k % 11 as varchar)) as rescue_location from logs where date_trunc('hour', occurred_at) >= date_trunc('hour', {AS_OF} - interval 30 day) group by 1, 2) select *, {rnd('(rescued * 1.0 / raised)', 4)} as ratio from s where {rnd('(rescued * 1.0 / raised)', 4)} >= 0.95")

# filters
LIST = {"unresolved": False, "search": "error FOR user 1", "severity": "high", "timeframe": "last_30_days", "frequency": "frequent", "hide_snoozed": True, "hide_muted": "true", "assigned_to": "__unassigned__", "application_id": [1, 2], "sort_by": "occurrence_count", "sort_direction": "asc"}
on_logs("b1_errors_list", lambda logs, as_of: filters.errors_list(logs, LIST, as_of).select("id", "error_type", "occurrence_count"), f"select id, error_type, occurrence_count from logs where lower(message) like '%error for user 1%' and {SEVERITY} = 'high' and {since(30)} and occurrence_count between 10 and 99 and (snoozed_until is null or snoozed_until < {AS_OF}) and not muted and assigned_to is null and application_id in (1, 2)")
on_logs("b2_equality_filters", lambda logs, as_of: filters.errors_list(logs, {"platform": "iOS", "app_version": "1.2.0", "status": "in_progress", "reopened": True, "timeframe": "unknown"}, as_of).select("id"), "select id from logs where platform = 'iOS' and app_version = '1.2.0' and status = 'in_progress' and reopened_at is not null and not resolved")
on_logs("b7_severity_low", lambda logs, as_of: filters.errors_list(logs, {"severity": "low", "timeframe": "yesterday"}, as_of).select("id"), f"select id from logs where {SEVERITY} = 'low' and not resolved and occurred_at >= timestamp '2024-01-29' and occurred_at < timestamp '2024-01-30'")
on_logs("b9_recurring", lambda logs, as_of: filters.errors_list(logs, {"frequency": "recurring", "unresolved": "0", "assigned_to": "__assigned__", "assignee_name": "dev1"}, as_of).select("id"), f"select id from logs where occurrence_count > 5 and last_seen_at > {AS_OF} - interval 1 day and assigned_to = 'dev1'")
on_logs("b13_critical_alerts", lambda logs, as_of: filters.critical_alerts(logs, as_of).select("id", "priority_level"), f"select id, priority_level from logs where occurred_at >= {AS_OF} - interval 1 hour and resolved_at is null and priority_level in (3, 4) order by occurred_at desc, id limit 10")
on_logs("b14_related_errors", lambda logs: filters.related_errors(logs, 17).select("id", "error_type"), "select id, error_type from logs where id <> 17 and error_type = (select error_type from logs where id = 17) order by occurred_at desc, id limit 5", clock=False)
SCOPES = {"unresolved": "not resolved", "resolved": "resolved", "last_24_hours": since(1), "last_week": since(7), "recent": f"occurred_at >= {AS_OF} - interval 1 hour", "stale": f"not resolved and occurred_at < {AS_OF} - interval 7 day", "snoozed": f"snoozed_until is not null and snoozed_until > {AS_OF}", "active": f"snoozed_until is null or snoozed_until < {AS_OF}", "assigned": "assigned_to is not null", "unassigned": "assigned_to is null", "muted": "muted", "unmuted": "not muted", "reopened": "reopened_at is not null"}
on_logs("b15_scopes", lambda logs, as_of: logs.agg(*[F.count_if(c).alias(n) for n, c in filters.scopes(as_of).items()]), "select " + ", ".join(f"count(*) filter ({c}) as {n}" for n, c in SCOPES.items()) + " from logs")
on_logs("b18_ingest_filter", lambda logs: logs.filter(~filters.ignored(F.col("error_type"), ["TypeError", "LoadError"], ["^Active"])).groupBy("error_type").count().withColumnRenamed("count", "n"), "select error_type, count(*) as n from logs where error_type not in ('TypeError', 'LoadError') and error_type not like 'Active%' group by 1", clock=False)
on_logs("b21_transitions", lambda logs: logs.select("status").distinct().select("status", *[filters.can_transition(F.col("status"), s).alias(f"to_{s}") for s in filters.TRANSITIONS]), "select distinct status, status in ('in_progress', 'resolved', 'wont_fix') as to_new, status in ('new', 'investigating') as to_in_progress, status in ('new', 'in_progress') as to_investigating, status in ('in_progress', 'investigating') as to_resolved, status in ('new', 'investigating') as to_wont_fix from logs", clock=False)
on_logs("h4_page", lambda logs, as_of: filters.page(filters.errors_list(logs, {}, as_of), 3).select("id"), "select id from logs where not resolved order by occurred_at desc, id limit 25 offset 50")

# functions
MESSAGE = r"regexp_replace(regexp_replace(regexp_replace(message, 'id: \d+\b', ':object_id', 'g'), '\b0x[0-9a-f]+\b', ':hex_value', 'g'), '\b\d{4,}\b', ':large_number', 'g')"
on_logs("f10_normalized_messages", lambda logs: logs.groupBy(text.normalized_message(F.col("message")).alias("message")).agg(F.count("*").alias("n")), f"select {MESSAGE} as message, count(*) as n from logs group by 1", clock=False)
on_logs("f13_error_hash", lambda logs: logs.select("id", text.error_hash(F.col("error_type"), F.col("message"), F.lit(None).cast("string"), F.col("platform"), F.lit("show"), F.col("application_id")).alias("hash")), f"select id, substr(sha256(concat_ws('|', error_type, {MESSAGE}, platform, 'show', cast(application_id as varchar))), 1, 16) as hash from logs", clock=False)
on_logs("f14_simple_messages", lambda logs: logs.groupBy(text.simple_message(F.col("message")).alias("message")).agg(F.count("*").alias("n")), "select regexp_replace(regexp_replace(message, '0x[0-9a-f]+', 'HEX', 'g'), '\\d+', 'N', 'g') as message, count(*) as n from logs group by 1", clock=False)
on_logs("f23_message_similarity", lambda logs: logs.select("id", numbers.round_half_up(text.message_similarity(F.col("message"), F.col("error_hash")), 6).alias("similarity")), f"select id, {rnd('(1 - levenshtein(message, error_hash) * 1.0 / greatest(length(message), length(error_hash)))', 6)} as similarity from logs", clock=False)


def _priority(logs: DataFrame, as_of) -> DataFrame:
    users = logs.filter("not resolved").groupBy("error_type").agg(F.count_distinct("user_id").alias("u"))
    hours = numbers.seconds(F.col("occurred_at"), as_of) / 3600
    u = F.when(F.col("user_id").isNotNull(), F.col("u")).otherwise(0)
    return logs.join(users, "error_type", "left").select("id", numbers.priority_score(severity.severity(F.col("error_type")), F.col("occurrence_count"), hours, u).alias("score"))


LOG = lambda x: rnd(f"least(greatest(10 + 30 * log10(greatest({x}, 1)), 0.0), 100.0)", 0)
on_logs("f4_priority_scores", _priority, f", u as (select error_type, count(distinct user_id) as u from logs where not resolved group by 1), x as (select logs.*, case when user_id is null then 0 else coalesce(u, 0) end as u, date_diff('microsecond', occurred_at, {AS_OF}) / 1e6 / 3600 as h, {SEVERITY} as s from logs left join u using (error_type)) select id, cast({rnd('(0.4 * case s when ' + chr(39) + 'critical' + chr(39) + ' then 100 when ' + chr(39) + 'high' + chr(39) + ' then 75 when ' + chr(39) + 'medium' + chr(39) + ' then 50 else 25 end + 0.25 * case when occurrence_count <= 1 then 10.0 when occurrence_count >= 1000 then 100.0 else ' + LOG('occurrence_count') + ' end + 0.2 * case when h < 1 then 100 when h < 24 then 80 when h < 168 then 50 when h < 720 then 20 else 10 end + 0.15 * case when u = 0 then 0.0 else ' + LOG('(u + 1)') + ' end)', 0)} as integer) as score from x")

# sequences
SHAPE = f"""hh as (select error_type, extract(hour from occurred_at) as h, count(*) as n, count(*) filter (extract(dow from occurred_at) in (0, 6)) as w from logs where {since(30)} group by 1, 2),
sh as (select error_type, cast(sum(n) as bigint) as total, sum(w) as wk, sum(n * n) as sq from hh group by 1),
pk as (select hh.error_type, count(*) filter (h between 9 and 17) as b, count(*) filter (h between 0 and 6) as g, string_agg(cast(h as varchar), ',' order by h) as peaks from hh join sh using (error_type) where n > 2 * (total / 24.0) group by 1),
cy as (select error_type, total, case when coalesce(b, 0) >= 3 then 'business_hours' when coalesce(g, 0) >= 2 then 'night' when wk * 100 > total * 50 then 'weekend' else 'uniform' end as pattern, least({rnd('(sqrt(greatest(sq / 24.0 - (total / 24.0) * (total / 24.0), 0)) / (total / 24.0))', 2)}, 1.0) as strength, coalesce(peaks, '') as peak_hours from sh left join pk using (error_type))"""
on_logs("g1_cyclical", lambda logs, as_of: sequences.cyclical(windows.since(logs, as_of, 30), ["error_type"]), f", {SHAPE} select * from cy")
ISLANDS = """
i1 as (select {key}, occurred_at, case when lag(occurred_at) over (partition by {key} order by occurred_at) is null or date_diff('microsecond', lag(occurred_at) over (partition by {key} order by occurred_at), occurred_at) > {gap} * 1000000 then 1 else 0 end as new from logs),
i2 as (select *, sum(new) over (partition by {key} order by occurred_at rows unbounded preceding) as i from i1),
bu as (select {key}, min(occurred_at) as start, max(occurred_at) as "end", count(*) as n from i2 group by {key}, i having count(*) >= {least})"""
on_logs("g2_bursts", lambda logs: sequences.bursts(logs, ["application_id"], gap=600), f", {ISLANDS.format(key='application_id', gap=600, least=5)} select *, {rnd('''(date_diff('microsecond', start, \"end\") / 1e6)''', 1)} as duration, case when n >= 20 then 'high' when n >= 10 then 'medium' else 'low' end as intensity from bu", clock=False)
on_logs("d41_recurring_patterns", sequences.recurring_patterns, f", {SHAPE} select cy.* from cy join (select error_type from logs where {since(30)} group by 1 order by count(*) desc, error_type limit 5) using (error_type) where strength > 0.05", strength=0.05)
on_logs("g7_rate_limits", lambda logs: sequences.rate_limited(logs.select("id", "platform", "occurred_at"), ["platform"], "occurred_at", F.lit(1), ["occurred_at", "id"]).filter("limited").select("id", "minute", "at"), """select id, minute, "at" from (select id, date_trunc('minute', occurred_at) as minute, cast(row_number() over (partition by platform, date_trunc('minute', occurred_at) order by occurred_at, id) as integer) as "at" from logs) where "at" > 1""", clock=False)
PERIODS = {"hourly": (28, "cast(extract(hour from occurred_at) as varchar)"), "daily": (84, "cast(cast(occurred_at as date) as varchar)"), "weekly": (365, "strftime(occurred_at, '%Y-%W')")}
SAMPLES = " union all ".join(f"select error_type, platform, '{k}' as baseline_type, cast(count(*) as double) as n from logs where {since(n)} group by error_type, platform, {p}" for k, (n, p) in PERIODS.items())
BASE = f"bs as (select *, avg(n) over w as m, stddev_pop(n) over w as s, count(*) over w as c from ({SAMPLES}) window w as (partition by error_type, platform, baseline_type)), ba as (select error_type, platform, baseline_type, sum(n) as count, {rnd('avg(n)', 2)} as mean, {rnd('stddev_pop(n)', 2)} as std_dev, {rnd('quantile_cont(n, 0.95)', 2)} as percentile_95, {rnd('quantile_cont(n, 0.99)', 2)} as percentile_99, count(*) as sample_size from bs where c < 3 or abs(n - m) <= 3 * s group by 1, 2, 3)"
on_logs("g8_baselines", sequences.baselines, f", {BASE} select * from ba")
ANOMALIES = f", {BASE}, nb as (select * from (select *, row_number() over (partition by error_type, platform order by case baseline_type when 'hourly' then 0 when 'daily' then 1 else 2 end) as z from ba) where z = 1), td as (select error_type, platform, count(*) as today from logs where occurred_at >= date_trunc('day', {AS_OF}) group by 1, 2), an as (select td.error_type, td.platform, today, baseline_type, mean, std_dev, case when today <= mean then null when std_dev = 0 then 'critical' when (today - mean) / std_dev < 2 then null when (today - mean) / std_dev <= 3 then 'elevated' when (today - mean) / std_dev <= 4 then 'high' else 'critical' end as level, case when std_dev <> 0 then {rnd('((today - mean) / std_dev)', 2)} end as deviations, today > mean + 2 * std_dev as exceeds from td join nb on td.error_type = nb.error_type and td.platform is not distinct from nb.platform)"
on_logs("g13_anomalies", lambda logs, as_of: sequences.anomalies(logs, sequences.baselines(logs, as_of), as_of), f"{ANOMALIES} select * from an")
on_logs("d6_spike", lambda logs, as_of: dashboard.spike(logs, as_of, sequences.baselines(logs, as_of)), f"""
{ANOMALIES}, a as (select count(*) filter (occurred_at >= date_trunc('day', {AS_OF})) as today, count(*) / 7.0 as mean from logs where {since(7)}),
b as (select *, {rnd('mean', 1)} as average from a), c as (select *, case when average > 0 then today / average else 0.0 end as times from b),
w as (select * from an where level is not null order by coalesce(deviations, 0) desc, error_type, platform nulls first limit 1)
select c.today, average, {rnd('times', 1)} as multiplier, level is not null or (c.mean > 0 and c.today >= 2 * c.mean) as spike,
  case when times >= 10 then 'critical' when times >= 5 then 'high' when times >= 2 then 'elevated' else 'normal' end as severity,
  level is not null as baseline_detected, error_type as anomaly_error_type, platform as anomaly_platform, level as anomaly_level, {rnd('deviations', 1)} as std_devs_above
from c left join w on true""")
on_logs("d19_pattern_insights", sequences.pattern_insights, f", {SHAPE}, tp as (select error_type, count(*) as n from logs where {since(30)} group by 1 order by n desc, error_type limit 5), md as (select error_type, arg_min(platform, (-k2, platform)) as platform from (select error_type, platform, count(*) as k2 from logs where {since(30)} and platform is not null group by 1, 2) group by 1), {ISLANDS.format(key='error_type', gap=60, least=5).replace('from logs)', f'from logs where {since(7)})')}, bc as (select error_type, count(*) as c from bu group by 1) select tp.error_type, tp.n, coalesce(platform, 'API') as platform, pattern, strength, coalesce(c, 0) as bursts from tp join cy using (error_type) left join md using (error_type) left join bc using (error_type)")

# time joins
def on_occurrences(name: str, plan: Callable[..., DataFrame], sql: str | None) -> None:
    ENTRIES[name] = (lambda spark, d: plan(driver.occurrences(spark, d)), None if sql is None else f"with {OCCURRENCES} {sql}")


PAIRS = "pr as (select a.error_log_id as parent_error_id, b.error_log_id as child_error_id, date_diff('microsecond', a.occurred_at, b.occurred_at) / 1e6 as delay from occ a join occ b on b.occurred_at > a.occurred_at and b.occurred_at <= a.occurred_at + interval 60 second and a.error_log_id <> b.error_log_id), ed as (select parent_error_id, child_error_id, count(*) as frequency, " + rnd("avg(delay)", 3) + " as avg_delay_seconds from pr group by 1, 2 having count(*) >= 3), ep as (select ed.*, " + rnd("(frequency * 1.0 / k)", 3) + " as cascade_probability from ed join (select error_log_id, count(*) as k from occ group by 1) o on o.error_log_id = parent_error_id)"


def _edges(occ: DataFrame) -> DataFrame:
    found = rangejoin.cascades(occ).withColumn("avg_delay_seconds", numbers.round_half_up(F.col("avg_delay_seconds"), 3))
    return rangejoin.with_probability(found, occ)


on_occurrences("c4_co_occurring", lambda occ: rangejoin.co_occurring(occ, 11), f", p as (select b.error_log_id, date_diff('microsecond', a.occurred_at, b.occurred_at) / 1e6 as delay from occ a join occ b on b.error_log_id <> 11 and b.occurred_at between a.occurred_at - interval 5 minute and a.occurred_at + interval 5 minute where a.error_log_id = 11) select error_log_id, count(*) as n, {rnd('avg(delay)', 2)} as avg_delay from p group by 1 having count(*) >= 2 order by n desc, error_log_id limit 10")
on_occurrences("c5_cascades", lambda occ: _edges(occ).drop("cascade_probability"), f", {PAIRS} select * from ed")
on_occurrences("c6_cascade_probability", _edges, f", {PAIRS} select * from ep")
on_occurrences("c7_cascade_neighbours", lambda occ: rangejoin.cascade_neighbours(_edges(occ), 11, 0.01), f", {PAIRS} select 'parent' as role, parent_error_id as error_id, frequency, cascade_probability from ep where child_error_id = 11 and cascade_probability >= 0.01 union all select 'child', child_error_id, frequency, cascade_probability from ep where parent_error_id = 11 and cascade_probability >= 0.01")
on_occurrences("c8_nearby", lambda occ: rangejoin.nearby(occ, 500).select("id", "error_log_id"), "select b.id, b.error_log_id from occ a join occ b on b.id <> 500 and b.occurred_at between a.occurred_at - interval 5 minute and a.occurred_at + interval 5 minute where a.id = 500")
on_occurrences("b16_occurrence_scopes", lambda occ: occ.filter(filters.occurrence_scopes(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-11 00:00:00").cast("timestamp_ntz"))["in_time_window"]).groupBy("user_id").agg(F.count("*").alias("n")), "select user_id, count(*) as n from occ where occurred_at between timestamp '2024-01-10' and timestamp '2024-01-11' group by 1")


def _merged(occ: DataFrame) -> DataFrame:
    early = rangejoin.cascades(occ.filter("occurred_at < timestamp_ntz'2024-01-15'"))
    late = rangejoin.cascades(occ.filter("occurred_at >= timestamp_ntz'2024-01-15'"))
    return rangejoin.merged_cascades(early, late).withColumn("avg_delay_seconds", numbers.round_half_up(F.col("avg_delay_seconds"), 3))


HALF = lambda op, n: f"{n} as (select a.error_log_id as p, b.error_log_id as c, count(*) as f, avg(date_diff('microsecond', a.occurred_at, b.occurred_at) / 1e6) as d from occ a join occ b on b.occurred_at > a.occurred_at and b.occurred_at <= a.occurred_at + interval 60 second and a.error_log_id <> b.error_log_id and a.occurred_at {op} timestamp '2024-01-15' and b.occurred_at {op} timestamp '2024-01-15' group by 1, 2 having count(*) >= 3)"
on_occurrences("i7_cascade_merge", _merged, f", {HALF('<', 'x')}, {HALF('>=', 'y')}, z as (select coalesce(x.p, y.p) as parent_error_id, coalesce(x.c, y.c) as child_error_id, case when x.f is not null and y.f is not null then x.f + 1 else coalesce(x.f, y.f) end as frequency, case when x.f is not null and y.f is not null then (x.d * x.f + y.d) / (x.f + 1) else coalesce(x.d, y.d) end as d from x full join y on x.p = y.p and x.c = y.c) select parent_error_id, child_error_id, frequency, {rnd('d', 3)} as avg_delay_seconds from z")

# state
on_logs("i1_folded_groups", lambda logs: grouping.folded(logs.select("application_id", "error_hash", "occurred_at")), None, clock=False)
ENTRIES["i1_folded_groups"] = (ENTRIES["i1_folded_groups"][0], f"""with recursive {LOGS}, s as (
  select application_id, error_hash, min(occurred_at) as first from logs group by 1, 2
  union all
  select s.application_id, s.error_hash, (select min(occurred_at) from logs l where l.application_id = s.application_id and l.error_hash = s.error_hash and l.occurred_at > s.first + interval 24 hour) as first
  from s where (select min(occurred_at) from logs l where l.application_id = s.application_id and l.error_hash = s.error_hash and l.occurred_at > s.first + interval 24 hour) is not null
)
select s.application_id, s.error_hash, s.first as first_seen_at, max(l.occurred_at) as last_seen_at, count(*) as occurrence_count
from s join logs l on l.application_id = s.application_id and l.error_hash = s.error_hash and l.occurred_at between s.first and s.first + interval 24 hour group by 1, 2, 3""")
on_logs("i5_throttled_alerts", lambda logs: grouping.throttled(logs.filter("priority_level = 4"), ["error_type"], 120), None, clock=False)
ENTRIES["i5_throttled_alerts"] = (ENTRIES["i5_throttled_alerts"][0], f"""with recursive {LOGS}, h as (select distinct error_type, occurred_at from logs where priority_level = 4), s as (
  select error_type, min(occurred_at) as occurred_at from h group by 1
  union all
  select s.error_type, (select min(h.occurred_at) from h where h.error_type = s.error_type and h.occurred_at > s.occurred_at + interval 120 minute)
  from s where (select min(h.occurred_at) from h where h.error_type = s.error_type and h.occurred_at > s.occurred_at + interval 120 minute) is not null
) select error_type, occurred_at from s""")


def _notify(logs: DataFrame) -> DataFrame:
    level = severity.severity(F.col("error_type"))
    gate = grouping.should_notify(F.col("occurrence_count"), level, F.col("muted"), F.col("reopened_at").isNotNull(), F.col("k") % 2 == 0, "medium")
    return logs.filter(gate).select("id")


on_logs("i4_notification_gate", _notify, f"select id from logs where not muted and case when reopened_at is not null then {SEVERITY} <> 'low' and k % 2 = 0 when occurrence_count = 1 then {SEVERITY} <> 'low' else occurrence_count in (10, 50, 100, 500, 1000) end", clock=False)


def _workflow(logs: DataFrame, as_of) -> DataFrame:
    logs = workflow.resolve(logs, F.col("id") % 20 == 3, as_of, by="ops")
    logs = workflow.assign(logs, F.col("id") % 20 == 4, "dev9", as_of)
    logs = workflow.set_status(logs, F.col("id") % 20 == 5, "wont_fix")
    logs = workflow.mute(logs, F.col("id") % 20 == 6, as_of, reason="noise")
    logs = workflow.snooze(logs, F.col("id") % 20 == 7, 12, as_of)
    logs = workflow.set_priority(logs, F.col("id") % 20 == 8, 3)
    logs = workflow.unassign(logs, F.col("id") % 20 == 9)
    return logs.groupBy("status", "resolved", "muted", "priority_level").agg(F.count("*").alias("n"), F.count("assigned_to").alias("assigned"), F.max("snoozed_until").alias("latest_snooze"))


on_logs("i9_workflow", _workflow, f"""
, w as (select id, case when id % 20 = 3 then true when id % 20 = 5 and status in ('new', 'investigating') then false else resolved end as resolved,
  case when id % 20 = 3 then 'resolved' when id % 20 = 4 then 'in_progress' when id % 20 = 5 and status in ('new', 'investigating') then 'wont_fix' else status end as status,
  case when id % 20 = 4 then 'dev9' when id % 20 = 9 then null else assigned_to end as assigned_to, muted or id % 20 = 6 as muted,
  case when id % 20 = 7 then {AS_OF} + interval 12 hour else snoozed_until end as snoozed_until, case when id % 20 = 8 then 3 else priority_level end as priority_level from logs)
select status, resolved, muted, priority_level, count(*) as n, count(assigned_to) as assigned, max(snoozed_until) as latest_snooze from w group by 1, 2, 3, 4""")
on_logs("i11_retention", lambda logs, as_of: workflow.retained(logs, {"c": (logs.select((F.col("id") + 5).alias("error_log_id")), ["error_log_id"])}, as_of, 10)["c"], f"select l.id + 5 as error_log_id from logs l where not exists (select 1 from logs o where o.id = l.id + 5 and o.occurred_at < {AS_OF} - interval 10 day)")
on_logs("c14_left_after_delete", lambda logs: workflow.delete(logs, logs.filter("muted")).groupBy("platform").agg(F.count("*").alias("n")), "select platform, count(*) as n from logs where not muted group by 1", clock=False)
on_logs("i12_status_backfill", lambda logs: workflow.backfilled_status(logs.withColumn("status", F.lit("new"))).groupBy("status").agg(F.count("*").alias("n")), "select case when resolved then 'resolved' else 'new' end as status, count(*) as n from logs group by 1", clock=False)


def queries() -> dict[str, Query]:
    from faultlens import catalog_ingest, catalog_json, catalog_layout, catalog_more, catalog_rollup, catalog_text, catalog_upsert, catalog_variables

    return {n: q for n, (q, _) in (ENTRIES | catalog_json.ENTRIES | catalog_ingest.ENTRIES | catalog_upsert.ENTRIES | catalog_text.ENTRIES | catalog_layout.ENTRIES | catalog_rollup.ENTRIES | catalog_variables.ENTRIES | catalog_more.ENTRIES).items()}


def oracle_sql() -> dict[str, str]:
    from faultlens import catalog_ingest, catalog_json, catalog_layout, catalog_more, catalog_rollup, catalog_text, catalog_upsert, catalog_variables

    return {n: s for n, (_, s) in (ENTRIES | catalog_json.ENTRIES | catalog_ingest.ENTRIES | catalog_upsert.ENTRIES | catalog_text.ENTRIES | catalog_layout.ENTRIES | catalog_rollup.ENTRIES | catalog_variables.ENTRIES | catalog_more.ENTRIES).items() if s}
