"""The keyed upsert of errors into groups, one occurrence after another, as batches and streams share it.

An occurrence counts for the group of its key that isn't resolved and began in the last 24 hours, of several the
one that was seen last; else it reopens the resolved or given-up group that was seen last, however old; else it opens a new group.
Workflow changes (resolve, wont_fix, mute, unmute) are events of the same sequence: they act on the group they name, or
on the key's group that was seen last if they name none. Ids of new groups follow from the key and the group's beginning, so that a
replay gives the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.severity import severity
from faultlens.operators.grouping import MILESTONES

#: What an event can be; any other kind is ignored.
KINDS = ("occurrence", "resolve", "wont_fix", "mute", "unmute")
KEYS = ["application_id", "error_hash"]
#: Statuses of which a group is opened again.
CLOSED = ("resolved", "wont_fix")
RANKS = {"low": 0, "medium": 1, "high": 2, "critical": 3}
OUTCOME_DDL = "application_id long, error_hash string, error_log_id long, outcome string, at_us long, first_us long, last_us long, occurrence_count long, resolved boolean, status string, muted boolean, reopened_us long, notify boolean, seq long, context string"
OUTCOME = pa.schema([("application_id", pa.int64()), ("error_hash", pa.string()), ("error_log_id", pa.int64()), ("outcome", pa.string()), ("at_us", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("occurrence_count", pa.int64()), ("resolved", pa.bool_()), ("status", pa.string()), ("muted", pa.bool_()), ("reopened_us", pa.int64()), ("notify", pa.bool_()), ("seq", pa.int64()), ("context", pa.string())])
GROUP_DDL = "id long, first_us long, last_us long, occurrence_count long, resolved boolean, status string, muted boolean, reopened_us long"
EVENT_DDL = "at_us long, kind string, target long, rank int, context string"


@dataclass(frozen=True)
class Rules:
    """How groups open and when they notify. ``cooldown`` holds between notifications of a key's reopened groups."""

    window: timedelta = timedelta(hours=24)
    cooldown: timedelta = timedelta(minutes=5)
    milestones: tuple[int, ...] = MILESTONES
    least: str = "low"


@dataclass
class Group:
    id: int
    first: int
    last: int
    count: int
    resolved: bool = False
    status: str = "new"
    muted: bool = False
    reopened: int | None = None


def new_id(key: tuple, first: int) -> int:
    """The id of a group that begins at ``first``: 60 bits of a digest."""
    app, name = ("" if k is None else k for k in key)
    return int(hashlib.sha256(f"{app}|{name}|{first}".encode()).hexdigest()[:15], 16)


class KeyState:
    """The groups of one key, when it last notified, and how many outcomes it has had.

    Groups lie in heaps by when they were seen last: all, those within their window and those that are closed. What no longer holds of an
    entry shows when it comes to the top, so that an event costs little however many groups there are. Times should ascend; one that
    doesn't has the heaps made anew.
    """

    def __init__(self, key: tuple, rules: Rules, groups: list[Group] | None = None, notified: int | None = None, seq: int = 0):
        self.key, self.rules, self.groups, self.notified, self.seq = key, rules, groups or [], notified, seq
        self.span = rules.window // timedelta(microseconds=1)
        self.now: int | None = None

    def apply(self, at: int, kind: str, target: int | None, rank: int | None, context: str | None) -> tuple | None:
        """The outcome of one event, in ``OUTCOME``'s order; none for a change without a group."""
        if self.now is None or at < self.now:
            self._index(at)
        self.now = at
        if kind == "occurrence":
            outcome, i = self._occurred(at)
            g = self.groups[i]
            notify = self._notifies(outcome, g, at, rank or 0)
            if notify:
                self.notified = at
        else:
            i = self._top(self.seen, lambda g: True) if target is None else max(self.of_id.get(target, ()), key=lambda i: self.groups[i].last, default=None)
            if i is None or kind not in KINDS:
                return None
            g, outcome, notify = self.groups[i], kind, False
            if kind in ("resolve", "wont_fix"):
                g.resolved, g.status = kind == "resolve" or g.resolved, "resolved" if kind == "resolve" else "wont_fix"
                heappush(self.closed, (-g.last, -g.id, i))
            else:
                g.muted = kind == "mute"
        self.seq += 1
        return (*self.key, g.id, outcome, at, g.first, g.last, g.count, g.resolved, g.status, g.muted, g.reopened, notify, self.seq, context)

    def _index(self, at: int) -> None:
        entries = [(-g.last, -g.id, i) for i, g in enumerate(self.groups)]
        self.seen, self.fresh, self.closed, self.of_id = entries, [], [], {}
        for entry, g in zip(entries, self.groups, strict=True):
            if not g.resolved and g.first >= at - self.span:
                self.fresh.append(entry)
            if g.status in CLOSED:
                self.closed.append(entry)
            self.of_id.setdefault(g.id, []).append(entry[2])
        for heap in (self.seen, self.fresh, self.closed):
            heapify(heap)

    def _top(self, heap: list[tuple[int, int, int]], holds: Callable[[Group], bool]) -> int | None:
        """The place of the group seen last of those for which an entry still says when, and ``holds``."""
        while heap:
            last, _, i = heap[0]
            if -last == self.groups[i].last and holds(self.groups[i]):
                return i
            heappop(heap)
        return None

    def _occurred(self, at: int) -> tuple[str, int]:
        outcome, i = "recurred", self._top(self.fresh, lambda g: not g.resolved and g.first >= at - self.span)
        if i is None:
            outcome, i = "reopened", self._top(self.closed, lambda g: g.status in CLOSED)
        if i is None:
            outcome, i = "created", len(self.groups)
            self.groups.append(Group(new_id(self.key, at), at, at, 0))
            self.of_id.setdefault(self.groups[i].id, []).append(i)
        g = self.groups[i]
        g.count, g.last = g.count + 1, max(g.last, at)
        if outcome == "reopened":
            g.resolved, g.status, g.reopened = False, "new", at
        entry = (-g.last, -g.id, i)
        heappush(self.seen, entry)
        if g.first >= at - self.span:
            heappush(self.fresh, entry)
        if g.status in CLOSED:
            heappush(self.closed, entry)
        return outcome, i

    def _notifies(self, outcome: str, g: Group, at: int, rank: int) -> bool:
        if g.muted:
            return False
        enough = rank >= RANKS[self.rules.least]
        if outcome == "created":
            return enough
        if outcome == "reopened":
            return enough and (self.notified is None or at > self.notified + self.rules.cooldown // timedelta(microseconds=1))
        return g.count in self.rules.milestones


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def ranked(error_type: Column, custom: dict[str, str] | None = None) -> Column:
    """The rank of an error type's severity, as events carry it."""
    names = F.create_map(*[F.lit(x) for name, i in RANKS.items() for x in (name, i)])
    return names[severity(error_type, custom)]


def as_groups(logs: DataFrame) -> DataFrame:
    """Stored error groups as the upsert takes them: keys and ``GROUP_DDL``."""
    return logs.select(
        *KEYS,
        "id",
        micros(F.col("occurred_at")).alias("first_us"),
        micros(F.coalesce("last_seen_at", "occurred_at")).alias("last_us"),
        F.coalesce(F.col("occurrence_count").cast("long"), F.lit(1)).alias("occurrence_count"),
        F.coalesce("resolved", F.lit(False)).alias("resolved"),
        F.coalesce("status", F.lit("new")).alias("status"),
        F.coalesce("muted", F.lit(False)).alias("muted"),
        micros(F.col("reopened_at")).alias("reopened_us"),
    )


def _steps(rules: Rules):
    """Rows (keys, at_us, kind, target, rank, context, group), a key's groups first and then its events by time -> ``OUTCOME``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: KeyState | None = None
        for batch in batches:
            out = []
            for app, name, at, kind, target, rank, context, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state.key != (app, name):
                    state = KeyState((app, name), rules)
                if group is not None:
                    state.groups.append(Group(*group.values()))
                    continue
                row = state.apply(at, kind, target, rank, context)
                if row:
                    out.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(OUTCOME, zip(*out, strict=True), strict=True)], schema=OUTCOME)

    return run


def _needed(groups: DataFrame, events: DataFrame, rules: Rules) -> DataFrame:
    """Those of ``groups`` that ``events`` can find: of a key with m events its group seen last, the m closed ones seen last and those within their
    window at the first event; all of a key with an event that names a group."""
    of_key = events.groupBy(*KEYS).agg(F.min("at_us").alias("_from"), F.count("*").alias("_m"), F.max(F.col("target").isNotNull()).alias("_named"))
    same = (groups.application_id.eqNullSafe(of_key.application_id)) & (groups.error_hash.eqNullSafe(of_key.error_hash))
    rows = groups.join(of_key, same).select(*[groups[c] for c in groups.columns], "_from", "_m", "_named")
    seen_last = Window.partitionBy(*KEYS).orderBy(F.desc("last_us"), F.desc("id"))
    closed = F.col("status").isin(*CLOSED)
    rows = rows.withColumn("_at", F.row_number().over(seen_last)).withColumn("_closed", F.sum(closed.cast("long")).over(seen_last.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fresh = ~F.col("resolved") & (F.col("first_us") >= F.col("_from") - rules.window // timedelta(microseconds=1))
    return rows.filter(F.col("_named") | (F.col("_at") == 1) | fresh | closed & (F.col("_closed") <= F.col("_m"))).select(groups.columns)


def outcomes(groups: DataFrame, events: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """What each of ``events`` (keys, ``EVENT_DDL``) does to ``groups`` (keys, ``GROUP_DDL``), as ``OUTCOME_DDL``.

    Events of the same time are taken by kind, context and target; one without a time does nothing. Rows of a key stream through one
    task, which holds those of the key's groups that its events can find; others are left out before the shuffle.
    """
    names = [c.split()[0] for c in GROUP_DDL.split(", ")]
    events = events.filter("at_us is not null")
    needed = _needed(groups.select(*KEYS, *names), events, rules)
    stored = needed.select(*KEYS, F.lit(None).cast("long").alias("at_us"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("target"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("context"), F.struct(*names).alias("group"))
    coming = events.select(*KEYS, "at_us", "kind", "target", "rank", "context", F.lit(None).cast(stored.schema["group"].dataType).alias("group"))
    rows = stored.unionByName(coming).repartition(*KEYS).sortWithinPartitions(*KEYS, F.asc_nulls_first("at_us"), "kind", "context", "target")
    return rows.mapInArrow(_steps(rules), OUTCOME_DDL)


def as_events(occurrences: DataFrame, context: Column | None = None) -> DataFrame:
    """Occurrences (keys, occurred_at, error_type) as events."""
    return occurrences.select(*KEYS, micros(F.col("occurred_at")).alias("at_us"), F.lit("occurrence").alias("kind"), F.lit(None).cast("long").alias("target"), ranked(F.col("error_type")).alias("rank"), (F.lit(None).cast("string") if context is None else context).alias("context"))


def latest(outcome: DataFrame) -> DataFrame:
    """The groups that ``outcomes`` touched, as they are after it: keys and ``GROUP_DDL``."""
    fields = ["first_us", "last_us", "occurrence_count", "resolved", "status", "muted", "reopened_us"]
    last = outcome.groupBy(*KEYS, "error_log_id").agg(F.max(F.struct("seq", *fields)).alias("x"))
    return last.select(*KEYS, F.col("error_log_id").alias("id"), *(f"x.{c}" for c in fields))
