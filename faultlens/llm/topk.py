"""Exact top-k search by inner product, over vectors in descending order of length.

Vectors are sorted by length into slabs of blocks and rotated to the right singular vectors of the whole
table, so that most of an inner product comes from the first coordinates. Every query is first scored
against the block of the longest vectors, which gives a score that its k-th best reaches at least, and
so, by Cauchy-Schwarz |q||x|, the length from which on vectors can still matter to it. The slabs are then
searched in rounds of descending length, each 32 times as large as the one before: a group of queries
goes only to the slabs that hold long enough vectors, and after each round what it needs is
determined anew. Within a task a block of vectors is skipped by its length, and single vectors by the
partial sum over the leading coordinates plus the product of the residual lengths. What is left is
scored in integers, and only the k best of each query leave the task. Bounds carry a margin for
rounding, so no vector that belongs to a result is pruned.

Queries against vectors is a product by its nature: where lengths are alike, nothing can be skipped and
work grows with queries times vectors. What is moved for it are ``group_bytes`` of queries and
``slab_bytes`` of vectors for each task; neither is broadcast.

Defined results: a vector that is null or holds a null or non-finite component takes no part; shorter
vectors are padded with zeros, an empty one has score 0 with all; ties go to the smaller vec_id; a
repeated query id is asked once, with its smallest row; rows that repeat a candidate are each a
candidate, but none with the query's own id; extra columns are ignored; an empty table gives no rows.
Components are 64-bit integers after scaling. Scores are exact at any size: where the product of the lengths
is beyond 64 bits, a pair is scored in Python's integers. As with the SQL's casts, a component or a
result's score that doesn't fit into 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import discard, staged

#: A score is high * 2^62 + rest, with 0 <= rest < 2^62.
SCORE = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("high", pa.int64()), ("rest", pa.int64())])
SCORE_DDL = "query_id long, vec_id long, high long, rest long"
BITS = 62
#: Up to this product of lengths, sums in 64 bits are exact.
SAFE = 2.0**BITS
#: Blocks of the first round; each round has this many times the blocks of the one before.
ROUND = 32
#: Tasks of a round at most, each with one group of queries and one slab.
MOST_TASKS = 20_000


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, q: array<long>, norm2: double) of the vectors that take part."""
    x = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id is not null and x is not null")
    ok = x.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    beyond = F.raise_error(F.lit("a component doesn't fit into 64 bits after scaling")).cast("long")
    cut = F.transform("x", lambda v: F.when((v * scale < 2.0**63) & (v * scale >= -(2.0**63)), F.floor(v * scale)).otherwise(beyond))
    return ok.select("vec_id", cut.alias("q")).withColumn("norm2", F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def _score() -> Column:
    """The score as a long; null beyond 64 bits."""
    return F.when(F.col("high").between(-2, 1), F.col("high") * F.lit(2**BITS) + F.col("rest"))


def _gram(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "value"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _bytes(m: np.ndarray) -> bytes:
    """A matrix in 32 bits a number where they do, else in 64."""
    fits = m.size == 0 or (m.min() >= -(2**31) and m.max() < 2**31)
    return m.astype(np.int32 if fits else np.int64).tobytes()


def _load(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * rows * dim else np.int64).reshape(rows, dim)


BLOCK = pa.schema([("at", pa.int32()), ("ids", pa.binary()), ("m", pa.binary()), ("length", pa.float64()), ("floors", pa.binary())])
BLOCK_DDL = "at int, ids binary, m binary, length double, floors binary"


def _pack(dim: int, size: int, asked: bool):
    """Blocks of at most ``size`` vectors of a sorted partition (vec_id, q, floor), numbered from 0.

    ``length`` is that of the longest, or for queries that from which on a vector can matter to one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            ids, m = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1), dim)
            floors = batch.column(2).to_numpy(zero_copy_only=False)
            for i in range(0, len(ids), size):
                part, low = m[i : i + size], floors[i : i + size]
                norms = np.sqrt((part.astype(np.float64) ** 2).sum(1))
                length = np.divide(low, norms, out=np.full(len(low), -np.inf), where=norms > 0).min() if asked else norms.max()
                row = (at, ids[i : i + size].tobytes(), _bytes(part), float(length), low.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK, strict=True)], schema=BLOCK)
                at += 1

    return run


class _Best:
    """A block of queries: what the bounds need of it, and the k best of each so far."""

    def __init__(self, ids: np.ndarray, z: np.ndarray, floors: np.ndarray, rotation: np.ndarray, lead: int, k: int):
        self.ids, self.z, self.floors, self.lead, self.k = ids, z, floors.copy(), lead, k
        q = z.astype(np.float64)
        self.norm = np.sqrt((q * q).sum(1))
        q = q @ rotation
        self.bound = np.concatenate([q[:, :lead], np.sqrt((q[:, lead:] ** 2).sum(1))[:, None]], axis=1)
        self.found = [np.zeros(0, np.int64)] * 4  # place of the query, vec_id, high, rest

    def add(self, ids: np.ndarray, z: np.ndarray, bound: np.ndarray, norms: np.ndarray) -> None:
        """Scores against a block of vectors; ``bound`` holds their leading coordinates and residual length."""
        live = np.flatnonzero(self.norm * norms.max(initial=0.0) * (1 + 1e-9) + 1e-6 >= self.floors)
        if not len(live) or not len(ids):
            return
        most = self.bound[live] @ bound.T
        slack = 1e-9 * (1 + self.norm[live]) * (1 + norms.max(initial=0.0)) + 1e-6
        own = np.isin(self.ids[live], ids)
        floors = self.floors[live]
        if (floors == -np.inf).any() and len(ids) > self.k:  # the k-th best lower bound within the block prunes the rest of it
            low = most - 2 * self.bound[live, -1:] * bound[None, :, -1]
            if own.any():
                low[self.ids[live][:, None] == ids[None, :]] = -np.inf
            floors = np.maximum(floors, np.partition(low, -self.k, axis=1)[:, -self.k] - slack)
        rows, cols = np.nonzero(most >= (floors - slack)[:, None])
        rows = live[rows]
        if own.any():
            other = self.ids[rows] != ids[cols]
            rows, cols = rows[other], cols[other]
        if not len(rows):
            return
        exact = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 200_000):
            r, c = rows[i : i + 200_000], cols[i : i + 200_000]
            exact[i : i + 200_000] = np.einsum("ij,ij->i", self.z[r].astype(np.int64), z[c].astype(np.int64))
        high, rest = exact >> BITS, exact & (2**BITS - 1)
        for i in np.flatnonzero(self.norm[rows] * norms[cols] >= SAFE):
            score = sum(map(mul, self.z[rows[i]].tolist(), z[cols[i]].tolist()))
            high[i], rest[i] = max(-(2**BITS), min(2**BITS, score >> BITS)), score & (2**BITS - 1)
        rows, ids_, high, rest = (np.concatenate(x) for x in zip(self.found, (rows, ids[cols], high, rest), strict=True))
        order = np.lexsort((ids_, -rest, -high, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        best = order[place < self.k]
        last = place == self.k - 1
        self.found = [rows[place < self.k], ids_[best], high[best], rest[best]]
        h, l_ = high[order[last]], rest[order[last]]
        self.floors[rows[last]] = np.maximum(self.floors[rows[last]], h * 2.0**BITS + l_)

    def rows(self) -> pa.RecordBatch:
        at, *rest = self.found
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[at], *rest)], schema=SCORE)


def _prepared(ids: bytes, m: bytes, dim: int, rotation: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    z = _load(m, len(ids), dim)
    x = z.astype(np.float64)
    norms = np.sqrt((x * x).sum(1))
    x = x @ rotation
    return ids, z, np.concatenate([x[:, :lead], np.sqrt((x[:, lead:] ** 2).sum(1))[:, None]], axis=1), norms


def _against(dim: int, k: int, rotation: np.ndarray, lead: int, head: tuple[bytes, bytes]):
    """Blocks of queries -> their k best of the one block ``head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _prepared(*head, dim, rotation, lead)
        for batch in batches:
            for ids, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int64)
                q = _Best(ids, _load(m, len(ids), dim), np.full(len(ids), -np.inf), rotation, lead, k)
                q.add(*x)
                yield q.rows()

    return run


def _search(dim: int, k: int, rotation: np.ndarray, lead: int):
    """Rows (task, asked, ids, m, floors), sorted: a task's blocks of queries come before its blocks of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, queries = None, []
        for batch in batches:
            for t, asked, ids, m, floors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    yield from (q.rows() for q in queries)
                    task, queries = t, []
                if asked:
                    i = np.frombuffer(ids, np.int64)
                    queries.append(_Best(i, _load(m, len(i), dim), np.frombuffer(floors, np.float64), rotation, lead, k))
                else:
                    x = _prepared(ids, m, dim, rotation, lead)
                    for q in queries:
                        q.add(*x)
        yield from (q.rows() for q in queries)

    return run


def _floors(asked: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The queries with ``floor``, which their k-th best score reaches, and ``need``, the length from which on a vector can matter."""
    kth = best.groupBy("query_id").agg(F.min(F.struct("high", "rest")).alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
    low = kth.select("query_id", "least.*").select(F.col("query_id").alias("vec_id"), F.coalesce(_score().cast("double"), F.col("high") * F.lit(2.0**BITS)).alias("floor"))
    found = asked.join(low, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return found.withColumn("need", F.when(F.col("norm2") > 0, F.col("floor") / F.sqrt("norm2")).otherwise(float("-inf")))


def _k_best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("high").desc(), F.col("rest").desc(), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, block: int = 2048, query_block: int = 512, energy: float = 0.7, slab_bytes: int = 1 << 25, group_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by ``every``, the k best others.

    ``energy``: share of the squared lengths that the leading coordinates hold. Through the driver go the
    rotation (dim squared numbers), the block of the longest vectors (``block`` of them, sent on with the
    function of the first pass) and one length for each slab and each group of queries.
    """
    spark = vectors.sparkSession
    rows = staged(quantised(vectors, scale), "vectors")
    shape = rows.agg(F.max(F.size("q")).alias("dim"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    if not shape.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, shape.dim)
    gram = np.zeros(dim * dim)
    for r in rows.select("q").mapInArrow(_gram(dim), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # dim squared rows
        gram[r["at"]] = r["value"]
    values, rotation = np.linalg.eigh(gram.reshape(dim, dim))
    values, rotation = np.maximum(values[::-1], 0), np.ascontiguousarray(rotation[:, ::-1])
    lead = int(min(dim, 1 + np.searchsorted(np.cumsum(values), energy * values.sum()))) if values.sum() else dim

    many = max(block, min(-(-shape.n // 512), slab_bytes // (8 * dim)))
    # the row's number spreads vectors of one length and one id over slabs
    numbered = rows.select("vec_id", "q", "norm2", F.lit(0.0).alias("floor"), F.monotonically_increasing_id().alias("row"))
    order = (F.col("norm2").desc(), F.col("vec_id"), F.col("row"))
    longest_first = numbered.repartitionByRange(-(-shape.n // many), *order).sortWithinPartitions(*order).select("vec_id", "q", "floor")
    packed = staged(longest_first.mapInArrow(_pack(dim, block, False), BLOCK_DDL).withColumn("part", F.spark_partition_id()), "blocks")
    lengths, slab_of = _merged(packed, many)
    head = packed.orderBy("part", "at").select("part", "ids", "m").first()
    others = packed.filter((F.col("part") != head["part"]) | (F.col("at") != 0))

    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("q", "norm2")).alias("x"))
    asked = staged(asked.select("vec_id", "x.q", "x.norm2", F.lit(0.0).alias("floor")), "queries")
    in_blocks = asked.select("vec_id", "q", "floor").mapInArrow(_pack(dim, query_block, True), BLOCK_DDL).select("ids", "m")
    best = staged(in_blocks.mapInArrow(_against(dim, k, rotation, lead, (bytes(head["ids"]), bytes(head["m"]))), SCORE_DDL), "best")

    together = max(query_block, group_bytes // (8 * dim))
    start, span = 0, max(1, ROUND * block * len(lengths) // shape.n)
    while shape.asked and start < len(lengths):
        by_need = _floors(asked.drop("floor"), best, k).repartitionByRange(-(-shape.asked // together), "need", "vec_id").sortWithinPartitions("need", "vec_id")
        packing = by_need.select("vec_id", "q", "floor").mapInArrow(_pack(dim, query_block, True), BLOCK_DDL)
        queries = staged(packing.withColumn("part", F.spark_partition_id()), "groups")
        groups, group_of = _merged(queries, together, F.min("length"))
        stop = min(len(lengths), start + span, start + max(1, MOST_TASKS // len(groups)))
        reach = [sum(x * (1 + 1e-8) + 1e-6 >= need for x in lengths[start:stop]) for need in groups]
        if not any(reach):
            break
        better = staged(_k_best(best.union(_round(queries, others, group_of, slab_of, reach, start, stop - start).mapInArrow(_search(dim, k, rotation, lead), SCORE_DDL)), k).drop("rank"), "best")
        discard(best)
        discard(queries)
        best, start, span = better, stop, span * ROUND
    for passed in (rows, packed, asked):
        discard(passed)
    beyond = F.raise_error(F.lit("a score doesn't fit into 64 bits")).cast("long")
    return _k_best(best, k).select("query_id", "rank", "vec_id", F.coalesce(_score(), beyond).alias("score"))


def _merged(packed: DataFrame, many: int, length: Column | None = None) -> tuple[list[float], list[int]]:
    """Partitions that follow each other, merged up to about ``many`` vectors: the length of each, and the number of the one that each partition is in."""
    length = F.max("length") if length is None else length
    parts = packed.groupBy("part").agg(F.sum(F.octet_length("ids") / 8).alias("n"), length.alias("length")).orderBy("part").collect()  # one row for so many vectors
    lengths: list[float] = []
    at = [0] * (1 + max(r["part"] for r in parts))
    n = float("inf")
    for r in parts:
        if n + r["n"] > many * 1.5:
            lengths.append(r["length"])
            n = 0
        n += r["n"]
        at[r["part"]] = len(lengths) - 1
    return lengths, at


def _round(queries: DataFrame, vectors: DataFrame, group_of: list[int], slab_of: list[int], reach: list[int], start: int, span: int) -> DataFrame:
    """Deals each group of queries to the first ``reach`` of the slabs from ``start`` on, and those slabs to it."""
    group = F.element_at(F.lit(group_of), F.col("part") + 1)
    slab = F.element_at(F.lit(slab_of), F.col("part") + 1) - start
    of_group = F.element_at(F.lit(reach), group + 1)
    asked = queries.filter(of_group > 0).select(F.explode(F.sequence(F.lit(0), of_group - 1)).alias("slab"), group.alias("group"), F.lit(True).alias("asked"), "part", "at", "ids", "m", "floors")
    needs = F.filter(F.sequence(F.lit(0), F.lit(len(reach) - 1)), lambda g: F.element_at(F.lit(reach), g + 1) > F.col("slab"))
    there = vectors.withColumn("slab", slab).filter(F.col("slab").between(0, span - 1))
    there = there.select("slab", F.explode(needs).alias("group"), F.lit(False).alias("asked"), "part", "at", "ids", "m", "floors")
    both = asked.union(there).withColumn("task", F.col("group") * span + F.col("slab"))
    dealt = both.repartitionById(len(reach) * span, "task")
    return dealt.sortWithinPartitions("task", F.col("asked").desc(), "part", "at").select("task", "asked", "ids", "m", "floors")
