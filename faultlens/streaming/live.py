"""Streams: counters, live figures, grouping and throttling with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def swallowed_counters(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Raises and rescues (exception_class, raise_location, rescue_location, kind, at: timestamp) -> hourly counts."""
    hour = F.window("at", "1 hour")
    per = events.withWatermark("at", late).groupBy(hour, "exception_class", "raise_location", "rescue_location").agg(F.count_if(F.col("kind") == "raise").alias("raise_count"), F.count_if(F.col("kind") == "rescue").alias("rescue_count"), F.max("at").alias("last_seen_at"))
    return per.select(F.col("window.start").alias("period_hour"), "exception_class", "raise_location", "rescue_location", "raise_count", "rescue_count", "last_seen_at")


def live_counts(events: DataFrame, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", every).alias("w"), "error_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "error_type", "n")


def bursts(events: DataFrame, late: str = "10 minutes", gap: str = "60 seconds", least: int = 5) -> DataFrame:
    per = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "error_type").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"))
    return per.filter(F.col("n") >= least).select("error_type", "start", "end", "n")


def grouped(events: DataFrame, window: timedelta = timedelta(hours=24), late: str = "24 hours") -> DataFrame:
    """(application_id, error_hash, at) -> a change of a group for each batch that touches it: first_seen_at, last_seen_at, occurrence_count.

    The state of a key is three values, and a key's rows of a batch are taken in the order of time, so that
    a batch gives what ``operators.grouping.folded`` does. A key that rests for the window, in event time, is forgotten;
    rows later than ``late`` are dropped. A row that comes in a later batch but is older than the open
    group joins it, as its new start, if it is within the window of it, and else is a group by itself.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, count = state.get if state.exists else (None, None, 0)
        rows = []
        span = window.total_seconds() * 1e6
        for us in _in_order(frames):
            if first is not None and us < first - span:
                rows.append((*key, us, us, 1))
            elif first is not None and us - first <= span:
                first, last, count = min(first, us), max(last, us), count + 1
            else:
                if first is not None:
                    rows.append((*key, first, last, count))
                first, last, count = us, us, 1
        rows.append((*key, first, last, count))
        state.update((first, last, count))
        state.setTimeoutTimestamp(max(last // 1000 + int(window.total_seconds() * 1000), state.getCurrentWatermarkMs()) + 1)
        out = pd.DataFrame(rows, columns=["application_id", "error_hash", "first_us", "last_us", "occurrence_count"])
        yield out

    return events.withWatermark("at", late).groupBy("application_id", "error_hash").applyInPandasWithState(step, "application_id long, error_hash string, first_us long, last_us long, occurrence_count long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def _in_order(frames: Iterator[pd.DataFrame]) -> list[int]:
    """The microseconds of a key's rows in a batch, which come in several frames, by time."""
    return sorted(at.value // 1000 for frame in frames for at in frame["at"])


def throttled(alerts: DataFrame, keys: str = "error_hash", minutes: float = 5, late: str = "24 hours") -> DataFrame:
    """(key, at) -> the alerts that are sent: later than ``minutes`` after the last one sent of the key.

    The state of a key is the last time, and is forgotten once the watermark is ``minutes`` past it.
    """
    pause = minutes * 60e6

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        sent = []
        for us in _in_order(frames):
            if last is None or us - last > pause:
                last = us
                sent.append((key[0], us))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + pause) // 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(sent, columns=[keys, "at_us"])

    return alerts.withWatermark("at", late).groupBy(keys).applyInPandasWithState(step, f"{keys} string, at_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
