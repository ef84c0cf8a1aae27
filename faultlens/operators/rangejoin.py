"""Joins over time windows, as equi-joins on time buckets, sums over the pairs of such windows, and what is built on them."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.numbers import round_half_up


def micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def range_join(left: DataFrame, right: DataFrame, at_left: str, at_right: str, seconds: float, symmetric: bool, parts: int = 8) -> DataFrame:
    """Pairs with 0 <= right - left <= seconds, or either way round if symmetric; adds ``delay`` in seconds, signed.

    Time is cut into buckets of a ``parts``-th of the window. A left row goes to each bucket its window touches, a right row
    to its own, so a pair meets once, few pairs meet that are too far apart, and a busy window is spread over ``parts`` keys.
    Rows without a time have no pair.
    """
    width = int(seconds * 1_000_000)
    step = -(-width // parts)
    bucket = lambda us: F.floor(us / step).cast("bigint")
    us_a = micros(F.col(at_left))
    a = left.withColumn("_us_a", us_a).filter("_us_a is not null").withColumn("_b", F.explode(F.sequence(bucket(F.col("_us_a") - (width if symmetric else 0)), bucket(F.col("_us_a") + width))))
    b = right.withColumn("_us_b", micros(F.col(at_right))).withColumn("_b", bucket(F.col("_us_b")))
    apart = F.col("_us_b") - F.col("_us_a")
    within = apart.between(-width if symmetric else 0, width)
    return a.join(b, "_b").filter(within).withColumn("delay", apart / 1e6).drop("_us_a", "_us_b", "_b")


#: How many times the widest delay a chunk of ``pair_sums`` is long.
CHUNK = 4
SUMS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pairs", pa.int64()), ("us", pa.decimal128(38, 0))])


def _chunk_sums(least: int, most: int):
    """Rows (chunk, right, error, us, n) of one chunk -> ``SUMS``.

    The occurrences in reach are a difference of running sums, so that an error costs its pairs or, where these are more, a look-up for each row.
    """

    def run(rows: pa.Table) -> pa.Table:
        right, error, us, n = (rows.column(c).to_numpy() for c in ("right", "error", "us", "n"))
        out: list[tuple] = []
        if right.any() and not right.all():
            t = us - us.min()
            if float(n[right].sum()) * float(n[~right].sum()) * (int(t.max()) + 1) >= 2**62:
                n = n.astype(object)  # whole numbers of any size
            b = np.flatnonzero(right)[np.argsort(t[right], kind="stable")]
            tb, nb = t[b], n[b]
            children, code = np.unique(error[b], return_inverse=True)
            a = np.flatnonzero(~right)
            a = a[np.lexsort((t[a], error[a]))]
            parents, cuts = np.unique(error[a], return_index=True)
            for parent, of in zip(parents.tolist(), np.split(a, cuts[1:]), strict=True):
                ta, na = t[of], n[of]
                lo, hi = np.searchsorted(tb, ta + least, "left"), np.searchsorted(tb, ta + most, "right")
                many = hi - lo
                if many.sum() <= len(tb):
                    i = np.repeat(np.arange(len(ta)), many)
                    j = np.arange(len(i)) + np.repeat(lo - (np.cumsum(many) - many), many)
                    pairs = na[i] * nb[j]
                    delay, who = pairs * (tb[j] - ta[i]), code[j]
                else:
                    before = lambda x: np.concatenate([x[:1] * 0, np.cumsum(x)])
                    lo, hi = np.searchsorted(ta, tb - most, "left"), np.searchsorted(ta, tb - least, "right")
                    count, time = before(na), before(na * ta)
                    pairs = nb * (count[hi] - count[lo])
                    delay, who = pairs * tb - nb * (time[hi] - time[lo]), code
                sums = np.zeros((2, len(children)), n.dtype)
                np.add.at(sums[0], who, pairs)
                np.add.at(sums[1], who, delay)
                out += [(parent, child, k, Decimal(x)) for child, k, x in zip(children.tolist(), *sums.tolist(), strict=True) if k and child != parent]
        return pa.Table.from_arrays([pa.array(x, f.type) for f, x in zip(SUMS, zip(*out, strict=True) if out else [[]] * 4, strict=True)], schema=SUMS)

    return run


def pair_sums(left: DataFrame, right: DataFrame, least_us: int, most_us: int) -> DataFrame:
    """(a, b, pairs, us): for each error of ``left`` and other error of ``right``, the pairs of their occurrences with a delay of
    ``least_us`` to ``most_us``, and these delays' sum.

    Both are (error_log_id, occurred_at); rows without either have no pair. Time is cut into chunks of ``CHUNK`` times the widest delay: a right row
    goes to its own, a left row to those that it reaches. Pairs aren't enumerated where they are more than rows, so that work grows with
    rows times the errors within a chunk. A task holds a chunk's distinct times.
    """
    step = CHUNK * max(abs(least_us), abs(most_us))
    chunk = lambda us: F.floor(us / step).cast("bigint")

    def side(rows: DataFrame, is_right: bool) -> DataFrame:
        n = rows.select(F.col("error_log_id").cast("long").alias("error"), micros(F.col("occurred_at")).alias("us")).dropna().groupBy("error", "us").agg(F.count("*").alias("n"))
        own = chunk(F.col("us")) if is_right else F.explode(F.sequence(chunk(F.col("us") + least_us), chunk(F.col("us") + most_us)))
        return n.select(own.alias("chunk"), F.lit(is_right).alias("right"), "error", "us", "n")

    found = side(left, False).unionByName(side(right, True)).groupBy("chunk").applyInArrow(_chunk_sums(least_us, most_us), "a long, b long, pairs long, us decimal(38,0)")
    return found.groupBy("a", "b").agg(F.sum("pairs").alias("pairs"), F.sum("us").alias("us"))


def _mean_delay() -> Column:
    """Mean of the delays over all pairs, summed in whole microseconds."""
    return F.col("us").cast("double") / F.col("pairs") / 1e6


def co_occurring(occurrences: DataFrame, error_id: int, minutes: float = 5, least: int = 2, limit: int = 10) -> DataFrame:
    """Other errors within so many minutes of one error's occurrences, either way and inclusive."""
    width = int(minutes * 60_000_000)
    own, others = occurrences.filter(F.col("error_log_id") == error_id), occurrences.filter(F.col("error_log_id") != error_id)
    per = pair_sums(own, others, -width, width).select(F.col("b").alias("error_log_id"), F.col("pairs").alias("n"), round_half_up(_mean_delay(), 2).alias("avg_delay"))
    return per.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "error_log_id").limit(limit)


def cascades(occurrences: DataFrame, seconds: float = 60, least: int = 3) -> DataFrame:
    """Edges from an error to one that follows it, later than it but within so many seconds, at least ``least`` times."""
    per = pair_sums(occurrences, occurrences, 1, int(seconds * 1_000_000))
    return per.filter(F.col("pairs") >= least).select(F.col("a").alias("parent_error_id"), F.col("b").alias("child_error_id"), F.col("pairs").alias("frequency"), _mean_delay().alias("avg_delay_seconds"))


def with_probability(edges: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Frequency over the parent's occurrences; it can exceed 1."""
    parents = occurrences.groupBy(F.col("error_log_id").alias("parent_error_id")).agg(F.count("*").alias("_n"))
    return edges.join(parents, "parent_error_id").withColumn("cascade_probability", round_half_up(F.col("frequency") / F.col("_n"), 3)).drop("_n")


def merged_cascades(old: DataFrame, new: DataFrame) -> DataFrame:
    """A known edge gains one detection, with the batch's mean as one observation; an unknown one is taken as found."""
    keys = ["parent_error_id", "child_error_id"]
    n = new.select(*keys, F.col("frequency").alias("_f"), F.col("avg_delay_seconds").alias("_d"))
    both = old.select(*keys, "frequency", "avg_delay_seconds").join(n, keys, "full_outer")
    known, hit = F.col("frequency").isNotNull(), F.col("_f").isNotNull()
    mean = (F.col("avg_delay_seconds") * F.col("frequency") + F.col("_d")) / (F.col("frequency") + 1)
    return both.select(*keys, F.when(known & hit, F.col("frequency") + 1).otherwise(F.coalesce("frequency", "_f")).alias("frequency"), F.when(known & hit, mean).otherwise(F.coalesce("avg_delay_seconds", "_d")).alias("avg_delay_seconds"))


def cascade_neighbours(edges: DataFrame, error_id: int, least: float = 0.5) -> DataFrame:
    """Parents and children of an error, by probability."""
    sure = edges.filter(F.col("cascade_probability") >= least)
    side = lambda own, other, role: sure.filter(F.col(own) == error_id).select(F.lit(role).alias("role"), F.col(other).alias("error_id"), "frequency", "cascade_probability")
    return side("child_error_id", "parent_error_id", "parent").unionByName(side("parent_error_id", "child_error_id", "child"))


def nearby(occurrences: DataFrame, occurrence_id: int, minutes: float = 5) -> DataFrame:
    """Other occurrences around one, inclusive."""
    one = occurrences.filter(F.col("id") == occurrence_id).select(F.col("occurred_at").alias("at"))
    return range_join(one, occurrences.filter(F.col("id") != occurrence_id), "at", "occurred_at", minutes * 60, True).drop("at", "delay")
