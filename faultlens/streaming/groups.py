"""The upsert of errors into groups as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from faultlens.operators.upsert import EVENT_DDL, GROUP_DDL, KEYS, OUTCOME, OUTCOME_DDL, Group, KeyState, Rules

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = [c.split()[0] for c in EVENT_DDL.split(", ")]
_GROUP = [c.split()[0] for c in GROUP_DDL.split(", ")]


def with_lists_and_timers(spark: SparkSession) -> None:
    """Sets the state store to RocksDB where the session has the one that knows neither lists nor timers."""
    if "HDFSBacked" in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, _ROCKS)


class Upsert(StatefulProcessor):
    """Holds a key's events until the watermark has passed them and then applies them by time.

    State of a key: its groups (a list), when it last notified and how many outcomes it has had (a value), and the
    events that wait (a list). A timer is set to the first event that waits, and to when the first group is forgotten.
    """

    def __init__(self, rules: Rules, keep: timedelta):
        self.rules, self.keep = rules, keep // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.groups = handle.getListState("groups", GROUP_DDL)
        self.meta = handle.getValueState("meta", "notified_us long, seq long")
        self.waiting = handle.getListState("waiting", EVENT_DDL)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self.groups.appendValue(tuple(initialState[c] for c in _GROUP))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in _FIELDS) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in waiting if r[0] < now), key=_order)
        rest = [r for r in waiting if r[0] >= now]
        groups = [Group(*r) for r in self.groups.get()] if self.groups.exists() else []
        notified, seq = self.meta.get() if self.meta.exists() else (None, 0)
        state = KeyState(tuple(key), self.rules, groups, notified, seq)
        out = [o for r in due if (o := state.apply(*r))]
        kept = [g for g in state.groups if g.last + self.keep >= now]
        if kept:
            self.groups.put([(g.id, g.first, g.last, g.count, g.resolved, g.status, g.muted, g.reopened) for g in kept])
            self._wake(min(g.last for g in kept) + self.keep)
        else:
            self.groups.clear()
        if kept or rest:
            self.meta.update((state.notified, state.seq))
        else:
            self.meta.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[0] for r in rest))
        else:
            self.waiting.clear()
        names = OUTCOME.names
        return iter([Row(**dict(zip(names, o, strict=True))) for o in out])

    def close(self) -> None:
        pass


def _order(event: tuple) -> tuple:
    """Events of a key by time, kind, context and target, nulls first, as batches take them."""
    at, kind, target, _, context = event
    return (at, *((x is not None, x) for x in (kind, context, target)))


def upserted(events: DataFrame, groups: DataFrame | None = None, rules: Rules = Rules(), late: str = "10 minutes", keep: timedelta = timedelta(days=90)) -> DataFrame:  # noqa: B008
    """A stream of events (keys, ``EVENT_DDL``, at: timestamp) -> ``OUTCOME_DDL``, as ``operators.upsert.outcomes`` gives them for a batch.

    ``groups``: the stored groups (keys, ``GROUP_DDL``) when the stream first starts. Events come out once the watermark,
    ``late`` behind the last one, has passed them, in order of time whatever order they came in; what is later than that is
    dropped. Groups that weren't seen for ``keep`` are forgotten, as retention deletes them. The state store is RocksDB, unless the
    session names another that has lists and timers.
    """
    with_lists_and_timers(events.sparkSession)
    initial = groups.select(*KEYS, *_GROUP).groupBy(*KEYS) if groups is not None else None
    rows = events.filter("at_us is not null").select(*KEYS, *_FIELDS, "at").withWatermark("at", late)
    return rows.groupBy(*KEYS).transformWithState(Upsert(rules, keep), OUTCOME_DDL, "Append", "EventTime", initialState=initial)
