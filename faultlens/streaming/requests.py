"""What requests leave on a stream: the last breadcrumbs of each, and how many came in a minute, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from faultlens.streaming.groups import with_lists_and_timers

MINUTE_MS = 60_000


class Ring(StatefulProcessor):
    """Keeps a request's last crumbs; hands them over once nothing came for ``idle`` milliseconds of event time."""

    def __init__(self, keep: int, idle: int):
        self.keep, self.idle = keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "at_us long, pos long, crumb string")
        self.wakes = handle.getValueState("wakes", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        for r in rows:
            held.append((r["at_us"], r["pos"], r["crumb"]))
            if len(held) > 2 * self.keep:
                held = sorted(held, key=_by_time)[-self.keep :]
        held = sorted(held, key=_by_time)[-self.keep :]
        self.ring.put(held)
        wake = max(held[-1][0] // 1000 + self.idle, timerValues.getCurrentWatermarkInMs() + 1)
        if self.wakes.exists():
            self.handle.deleteTimer(self.wakes.get()[0])
        self.handle.registerTimer(wake)
        self.wakes.update((wake,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = [tuple(r) for r in self.ring.get()]
        self.ring.clear()
        self.wakes.clear()
        return iter([Row(request_id=key[0], at=i, crumb=crumb) for i, (_, _, crumb) in enumerate(held, 1)])

    def close(self) -> None:
        pass


def _by_time(crumb: tuple) -> tuple:
    return tuple((x is not None, x) for x in crumb)


def last_crumbs(crumbs: DataFrame, keep: int = 40, idle: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """(request_id, at_time: timestamp, pos, crumb) -> the last ``keep`` crumbs of each request, numbered in order from 1, as ``plans.crumbs.last_crumbs`` of a batch.

    A request's crumbs come out once the watermark is ``idle`` past the last one. State is ``keep`` crumbs a request. Crumbs later than the watermark are
    dropped; one without a request isn't kept.
    """
    with_lists_and_timers(crumbs.sparkSession)
    ms = int(crumbs.sparkSession.range(1).select(F.expr(f"cast(interval {idle} as interval day to second)").alias("i")).first()[0].total_seconds() * 1000)
    rows = crumbs.filter("request_id is not null and at_time is not null").select("request_id", F.unix_micros("at_time").alias("at_us"), F.col("pos").cast("long").alias("pos"), F.col("crumb").cast("string").alias("crumb"), "at_time")
    return rows.withWatermark("at_time", late).groupBy("request_id").transformWithState(Ring(keep, ms), "request_id string, at long, crumb string", "Append", "EventTime")


class MinuteCounter(StatefulProcessor):
    """Counts a key's requests by calendar minute; a minute's count goes once the watermark has passed its end."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        by_minute: dict[int, list[tuple]] = {}
        for r in rows:
            by_minute.setdefault(r["at_us"] // (MINUTE_MS * 1000), []).append((r["at_us"], r["id"]))
        for minute, came in by_minute.items():
            n = self.counts.getValue((minute,))[0] if self.counts.containsKey((minute,)) else 0
            if n == 0:
                self.handle.registerTimer((minute + 1) * MINUTE_MS)
            for us, i in sorted(came, key=lambda r: (r[0], r[1] is not None, r[1])):
                n += 1
                yield Row(key=key[0], id=i, at_us=us, at=n, limited=n > self.limit)
            self.counts.updateValue((minute,), (n,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        minute = (expiredTimerInfo.getExpiryTimeInMs() // MINUTE_MS - 1,)
        if self.counts.containsKey(minute):
            self.counts.removeKey(minute)
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int, late: str = "1 minute") -> DataFrame:
    """(key: string, id: long, at_time: timestamp) -> each request with its number in the minute of its key and whether that exceeds the limit.

    Requests are numbered as they come, those of a batch by time and id; over batches in order of time that is what ``sequences.rate_limited`` gives.
    """
    with_lists_and_timers(requests.sparkSession)
    rows = requests.filter("at_time is not null").select("key", "id", F.unix_micros("at_time").alias("at_us"), "at_time")
    found = rows.withWatermark("at_time", late).groupBy("key").transformWithState(MinuteCounter(limit), "key string, id long, at_us long, at long, limited boolean", "Append", "EventTime")
    return found.select("key", "id", F.date_trunc("MINUTE", F.timestamp_micros("at_us")).alias("minute"), "at", "limited")
