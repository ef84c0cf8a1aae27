"""Occurrences folded into error groups, and gates on notifications, as ordered scans of each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.rangejoin import micros

MILESTONES = (10, 50, 100, 500, 1000)


class Jumps:
    """What is known of a key while its sorted times stream by. ``take`` goes over many times at once, ``end`` comes at the key's end; both give output rows."""

    def take(self, key: tuple, times: np.ndarray, counts: np.ndarray) -> list[tuple]:
        raise NotImplementedError

    def end(self, key: tuple) -> list[tuple]:
        return []


def _cuts(columns: list[pa.Array], n: int) -> list[int]:
    """Where a batch's rows begin another key than the row before, and its end."""
    other = np.zeros(max(0, n - 1), bool)
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        gone, come = pc.is_null(a), pc.is_null(b)
        other |= pc.if_else(pc.or_(gone, come), pc.xor(gone, come), pc.not_equal(a, b)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(other) + 1).tolist(), n]


def ordered_jumps(df: DataFrame, keys: list[str], make: Callable[[], Jumps], schema: pa.Schema, ddl: str) -> DataFrame:
    """Jumps over each key's times (occurred_at, n), which stream by in order. The state of one key is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: Jumps | None = None
        for batch in batches:
            out: list[tuple] = []
            columns = batch.columns
            times = columns[len(keys)].cast(pa.int64()).to_numpy(zero_copy_only=False)
            counts = columns[len(keys) + 1].to_numpy(zero_copy_only=False)
            cuts = _cuts(columns[: len(keys)], batch.num_rows)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                k = tuple(c[a].as_py() for c in columns[: len(keys)])
                if state is None or k != key:
                    if state is not None:
                        out.extend(state.end(key))
                    key, state = k, make()
                out.extend(state.take(k, times[a:b], counts[a:b]))
            if out:
                yield _batch(out, schema)
        if state is not None and (out := state.end(key)):
            yield _batch(out, schema)

    return df.select(*keys, "occurred_at", "n").repartition(*keys).sortWithinPartitions(*keys, "occurred_at").mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True), strict=True)], schema=schema)


class Folds(Jumps):
    """Groups of what occurs within ``span`` microseconds of a first occurrence."""

    def __init__(self, span: int):
        self.span, self.open = span, None

    def take(self, key: tuple, times: np.ndarray, counts: np.ndarray) -> list[tuple]:
        done, at = [], 0
        while at < len(times):
            if self.open is None:
                self.open = (int(times[at]), int(times[at]), 0)
            first, last, n = self.open
            to = int(np.searchsorted(times, first + self.span, "right"))
            if to > at:
                self.open = (first, int(times[to - 1]), n + int(counts[at:to].sum()))
            if to < len(times):
                done += self.end(key)
            at = to
        return done

    def end(self, key: tuple) -> list[tuple]:
        row, self.open = (*key[:-1], *self.open), None
        return [row]


class Pauses(Jumps):
    """The first time, and each that is later than ``pause`` microseconds after the last one taken."""

    def __init__(self, pause: int):
        self.pause, self.last = pause, None

    def take(self, key: tuple, times: np.ndarray, counts: np.ndarray) -> list[tuple]:
        sent = []
        at = 0 if self.last is None else int(np.searchsorted(times, self.last + self.pause, "right"))
        while at < len(times):
            self.last = int(times[at])
            sent.append((*key[:-1], self.last))
            at = int(np.searchsorted(times, self.last + self.pause, "right"))
        return sent


def with_runs(rows: DataFrame, keys: list[str], span: timedelta) -> DataFrame:
    """Adds ``_run``: a key's occurrences that have no pause longer than ``span`` between them have one number.

    What is anchored at most ``span`` before an occurrence starts anew after such a pause, so that runs can be
    scanned apart. Pauses are found between spans of a key's time, of which one row each is kept (a pause within
    one can't be longer than it), so no task sees all rows of a key.
    """
    us = int(span / timedelta(microseconds=1))
    span_of = F.floor(micros(F.col("occurred_at")) / us).cast("bigint")
    ends = rows.groupBy(*keys, span_of.alias("_span")).agg(F.min("occurred_at").alias("_lo"), F.max("occurred_at").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_span")
    paused = F.coalesce(micros(F.col("_lo")) - micros(F.lag("_hi").over(w)) > us, F.lit(False))
    runs = ends.withColumn("_paused", paused.cast("bigint")).select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_span", F.sum("_paused").over(w).alias("_run"))
    spans = rows.withColumn("_at_span", span_of)
    same = F.col("_at_span").eqNullSafe(F.col("_span"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return spans.join(runs, same).select(*rows.columns, "_run")


def folded(occurrences: DataFrame, window: timedelta = timedelta(hours=24)) -> DataFrame:
    """(application_id, error_hash, occurred_at) -> one row per group: first_seen_at, last_seen_at, occurrence_count.

    A group takes what occurs within the window from its first occurrence; later ones open another.
    Equal times of a key are counted before the shuffle, and a key is cut at its pauses, so that a task is as
    long as the distinct times of a key without a pause longer than the window.
    """
    keys = ["application_id", "error_hash"]
    rows = with_runs(occurrences.filter("occurred_at is not null").groupBy(*keys, "occurred_at").agg(F.count("*").alias("n")), keys, window)
    schema = pa.schema([("application_id", pa.int64()), ("error_hash", pa.string()), ("first_seen_at", pa.timestamp("us")), ("last_seen_at", pa.timestamp("us")), ("occurrence_count", pa.int64())])
    span = window // timedelta(microseconds=1)
    return ordered_jumps(rows, [*keys, "_run"], lambda: Folds(span), schema, "application_id long, error_hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, occurrence_count long")


def chosen(groups: DataFrame, as_of: Column) -> DataFrame:
    """(_app, _hash, _hit, _rank): the group that takes a key's new occurrences, 0 for one that counts them and 1 for one that reopens."""
    keys = ["application_id", "error_hash"]
    fresh = ~F.col("resolved") & (F.col("occurred_at") >= as_of - F.expr("interval 24 hours"))
    closed = F.col("status").isin("resolved", "wont_fix")
    rank = F.when(fresh, 0).when(closed, 1)
    first = F.min(F.struct(rank.alias("rank"), (-F.unix_micros(F.col("occurred_at").cast("timestamp"))).alias("at"), F.col("id").alias("hit"))).alias("_b")
    best = groups.filter(rank.isNotNull()).groupBy(*keys).agg(first)
    return best.select(F.col("application_id").alias("_app"), F.col("error_hash").alias("_hash"), F.col("_b.hit").alias("_hit"), F.col("_b.rank").alias("_rank"))


def merged_groups(groups: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """A batch of new occurrences (application_id, error_hash, error_type, message, occurred_at) against stored groups.

    Of each key the newest unresolved group created in the last 24 hours counts them; else the newest
    resolved or given-up group reopens with them; else they make a new group, whose id is null.
    """
    keys = ["application_id", "error_hash"]
    new = batch.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("occurred_at").alias("_first"), F.max("occurred_at").alias("_last"), F.max(F.struct("occurred_at", "error_type", "message")).alias("_x"))
    best = chosen(groups, as_of)
    same = F.col("application_id").eqNullSafe(F.col("_app")) & F.col("error_hash").eqNullSafe(F.col("_hash"))
    target = new.join(best, same, "left").drop("_app", "_hash")
    kept = groups.join(target.filter("_hit is not null").select(F.col("_hit").alias("id"), "_n", "_last", "_rank"), "id", "left")
    reopened = F.col("_rank") == 1
    updated = kept.withColumn("occurrence_count", F.col("occurrence_count") + F.coalesce("_n", F.lit(0))).withColumn("last_seen_at", F.greatest("last_seen_at", "_last")).withColumn("reopened_at", F.when(reopened, as_of).otherwise(F.col("reopened_at"))).withColumn("resolved", F.col("resolved") & ~F.coalesce(reopened, F.lit(False))).withColumn("status", F.when(reopened, "new").otherwise(F.col("status"))).drop("_n", "_last", "_rank")
    inserted = target.filter("_hit is null").select(*keys, F.col("_x.error_type").alias("error_type"), F.col("_x.message").alias("message"), F.col("_first").alias("occurred_at"), F.col("_last").alias("last_seen_at"), F.col("_n").alias("occurrence_count"), F.lit(False).alias("resolved"), F.lit("new").alias("status"))
    return updated.unionByName(inserted, allowMissingColumns=True)


def appended_occurrences(groups: DataFrame, batch: DataFrame, as_of: Column, made: DataFrame) -> DataFrame:
    """The occurrences to append for a batch: each with the id of the group that ``merged_groups`` chooses for it.

    ``groups``: as stored before the merge; ``made``: (application_id, error_hash, id) of the groups that it opened.
    """
    opened = made.select(F.col("application_id").alias("_app"), F.col("error_hash").alias("_hash"), F.col("id").alias("_hit"))
    taking = chosen(groups, as_of).select("_app", "_hash", "_hit").unionByName(opened)
    same = F.col("application_id").eqNullSafe(F.col("_app")) & F.col("error_hash").eqNullSafe(F.col("_hash"))
    context = [c for c in ("occurred_at", "user_id", "request_id", "session_id") if c in batch.columns]
    return batch.join(taking, same).select(F.col("_hit").alias("error_log_id"), *context)


def throttled(alerts: DataFrame, keys: list[str], minutes: float) -> DataFrame:
    """Alerts of each key that are sent: the first, and each that is later than ``minutes`` after the last one sent.

    ``alerts``: key columns and occurred_at. Equal times are met before the shuffle, and keys are cut at pauses longer than that.
    """
    pause = timedelta(minutes=minutes)

    types = dict(alerts.dtypes)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([*((k, arrow[types[k]]) for k in keys), ("occurred_at", pa.timestamp("us"))])
    rows = with_runs(alerts.filter("occurred_at is not null").select(*keys, "occurred_at").distinct(), keys, pause).withColumn("n", F.lit(1).cast("long"))
    us = pause // timedelta(microseconds=1)
    return ordered_jumps(rows, [*keys, "_run"], lambda: Pauses(us), schema, ", ".join([*(f"{k} {types[k]}" for k in keys), "occurred_at timestamp_ntz"]))


def should_notify(count: Column, severity: Column, muted: Column, reopened: Column, cooled: Column, least: str = "low") -> Column:
    """New errors of enough severity, reopened ones after their pause, milestones of recurring ones; muted ones never."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(("low", "medium", "high", "critical")) for x in (s, i)])
    enough = order[severity] >= order[F.lit(least)]
    return ~muted & F.when(reopened, enough & cooled).when(count == 1, enough).otherwise(count.isin(*MILESTONES))
