"""The error list: optional filters, whitelisted sorting, pages."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.severity import severity_is
from faultlens.functions.text import text_matches, token_matches
from faultlens.operators import fulltext
from faultlens.operators.windows import day_start, days

#: Fixed values.
FREQUENCY = {"once": lambda n, _: n == 1, "few": lambda n, _: n.between(2, 9), "frequent": lambda n, _: n.between(10, 99), "very_frequent": lambda n, _: n >= 100, "recurring": lambda n, old: (n > 5) & old}
#: Fixed values.
SORTABLE = ("occurred_at", "first_seen_at", "last_seen_at", "created_at", "resolved_at", "error_type", "platform", "app_version", "occurrence_count", "priority_score", "status")
#: Which status may follow which.
TRANSITIONS = {"new": ["in_progress", "investigating", "wont_fix"], "in_progress": ["investigating", "resolved", "new"], "investigating": ["resolved", "in_progress", "wont_fix"], "resolved": ["new"], "wont_fix": ["new"]}


def predicates(filters: dict[str, Any], as_of: Column, columns: list[str]) -> list[Column]:
    """One predicate per filter that says something; blank and unknown values, and missing columns, say nothing."""
    out: list[Column] = []
    value = lambda name: None if filters.get(name) in (None, "") else filters[name]
    for name in ("error_type", "platform", "user_id", "app_version", "git_sha", "status"):
        if value(name) is not None and name in columns:
            out.append(F.col(name) == F.lit(value(name)))
    if value("priority_level") is not None and "priority_level" in columns:
        out.append(F.col("priority_level") == int(value("priority_level")))
    if (app := value("application_id")) is not None:
        out.append(F.col("application_id").isin(list(app) if isinstance(app, list | tuple | set) else [app]))
    if filters.get("unresolved") not in (False, "false", "0"):
        out.append(~F.col("resolved"))
    if value("search"):
        over = [F.col(c) for c in ("message", "backtrace", "error_type") if c in columns]
        if filters.get("search_mode") == "english":
            out.append(fulltext.matches(str(value("search")), F.concat_ws(" ", *over)))
        else:
            out.append((token_matches if filters.get("search_mode") == "tokens" else text_matches)(str(value("search")), *over))
    if value("severity"):
        out.append(severity_is(F.col("error_type"), str(value("severity"))))
    at = F.col("occurred_at")
    spans = {"last_hour": lambda: at >= as_of - days(1 / 24), "today": lambda: at >= day_start(as_of), "yesterday": lambda: (at >= day_start(as_of, 1)) & (at < day_start(as_of)), "last_7_days": lambda: at >= as_of - days(7), "last_30_days": lambda: at >= as_of - days(30), "last_90_days": lambda: at >= as_of - days(90)}
    if filters.get("timeframe") in spans:
        out.append(spans[filters["timeframe"]]())
    if filters.get("frequency") in FREQUENCY:
        out.append(FREQUENCY[filters["frequency"]](F.col("occurrence_count"), F.col("last_seen_at") > as_of - days(1)))
    assigned, who = value("assigned_to"), value("assignee_name")
    if "assigned_to" in columns:
        if assigned == "__unassigned__":
            out.append(F.col("assigned_to").isNull())
        elif assigned == "__assigned__":
            out.append(F.col("assigned_to").isNotNull())
            if who:
                out.append(F.col("assigned_to") == who)
        elif assigned or who:
            out.append(F.col("assigned_to") == (assigned or who))
    yes = lambda name: filters.get(name) in (True, "true", "1", 1)
    if yes("hide_snoozed") and "snoozed_until" in columns:
        out.append(active(as_of))
    if yes("hide_muted") and "muted" in columns:
        out.append(~F.col("muted"))
    if yes("reopened") and "reopened_at" in columns:
        out.append(F.col("reopened_at").isNotNull())
    return out


def active(as_of: Column) -> Column:
    return F.col("snoozed_until").isNull() | (F.col("snoozed_until") < as_of)


def errors_list(logs: DataFrame, filters: dict[str, Any], as_of: Column) -> DataFrame:
    """All filters in one predicate, sorted by a whitelisted column, then newest first, then id."""
    found = predicates(filters, as_of, logs.columns)
    rows = logs.filter(reduce(lambda a, b: a & b, found)) if found else logs
    by = filters.get("sort_by")
    by = "priority_score" if by == "severity" else by
    by = by if by in SORTABLE and by in logs.columns else "occurred_at"
    up = filters.get("sort_direction") == "asc"
    return rows.orderBy(F.col(by).asc() if up else F.col(by).desc(), F.col("occurred_at").desc(), "id")


def page(df: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """A page of an ordered table; numbers below 1 are the first."""
    return df.offset((max(1, number) - 1) * size).limit(size)


def critical_alerts(logs: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    hot = (F.col("occurred_at") >= as_of - days(1 / 24)) & F.col("resolved_at").isNull() & F.col("priority_level").isin(3, 4)
    return logs.filter(hot).orderBy(F.col("occurred_at").desc(), "id").limit(limit)


def related_errors(logs: DataFrame, error_id: int, limit: int = 5) -> DataFrame:
    """Newest others of the same type."""
    kind = logs.filter(F.col("id") == error_id).select(F.col("error_type").alias("_type"))
    return logs.filter(F.col("id") != error_id).join(F.broadcast(kind), F.col("error_type") == F.col("_type"), "left_semi").orderBy(F.col("occurred_at").desc(), "id").limit(limit)


def scopes(as_of: Column) -> dict[str, Column]:
    """Named predicates over error_logs."""
    at = F.col("occurred_at")
    return {
        "unresolved": ~F.col("resolved"),
        "resolved": F.col("resolved"),
        "last_24_hours": at >= as_of - days(1),
        "last_week": at >= as_of - days(7),
        "recent": at >= as_of - days(1 / 24),
        "stale": ~F.col("resolved") & (at < as_of - days(7)),
        "snoozed": F.col("snoozed_until").isNotNull() & (F.col("snoozed_until") > as_of),
        "active": active(as_of),
        "assigned": F.col("assigned_to").isNotNull(),
        "unassigned": F.col("assigned_to").isNull(),
        "muted": F.col("muted"),
        "unmuted": ~F.col("muted"),
        "reopened": F.col("reopened_at").isNotNull(),
    }


def occurrence_scopes(start: Column, end: Column) -> dict[str, Column]:
    return {"in_time_window": F.col("occurred_at").between(start, end)}


def cascade_scopes(min_frequency: int = 3) -> dict[str, Column]:
    sure, often = F.col("cascade_probability") >= 0.7, F.col("frequency") >= min_frequency
    return {"high_confidence": sure, "frequent": often, "strong": sure & (F.col("frequency") >= 3)}


def can_transition(status: Column, to: str) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in TRANSITIONS.items() for x in (k, v)])
    return F.coalesce(F.array_contains(table[status], to), F.lit(False))


def ignored(error_type: Column, names: list[str] = (), patterns: list[str] = (), ancestors: Column | None = None) -> Column:
    """Whether ingest drops a type: by name, by an ancestor class, or by pattern. A null type isn't dropped."""
    out = error_type.isin(list(names)) if names else F.lit(False)
    if ancestors is not None and names:
        out = out | F.arrays_overlap(ancestors, F.array(*[F.lit(n) for n in names]))
    return F.coalesce(reduce(lambda a, p: a | error_type.rlike(p), patterns, F.coalesce(out, F.lit(False))), F.lit(False))


def sampled(key: Column, severity: Column, rate: float) -> Column:
    """Whether ingest keeps a row: all critical ones, of others a share by a hash of the key."""
    return F.lit(rate >= 1) | (severity == "critical") | (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000))
