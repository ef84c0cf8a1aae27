"""Exact dedup over a log-structured merge index of text digests.

Memtables: each task gathers (digest, row) entries of its documents and flushes them as sorted runs.
Compaction merges the runs that were flushed since the last one to a part with one row per digest: how
many rows have it and which of them stays; parts of a level are merged to one of the next level when
there are ``fanout`` of them. A merged part takes the place of those that it was made of, in a new version of the
index's manifest, which is all that a reader looks at; so a compaction that fails leaves the index as it was.

Hits, digests of more than one row, are verified byte by byte. A Bloom filter over them, of ``filter_bytes``
at most, keeps other texts out of the shuffle; should there be more hits than it can tell apart, it lets more texts
through, and the join behind it decides. Normalised texts are then grouped as a whole, with equal
texts met within each batch before the shuffle, so that a huge group of copies is a few rows per task.
Should a digest turn out to stand for several texts, its rows are told apart by the texts themselves.

Defined results: texts are equal when identical after deleting ASCII white space; null is empty, and
equal to other empty texts; of equal texts the row with most code points stays, then the smallest
doc_id (a null one last), then any one of rows that are the same; each input row gives one output row;
extra columns are ignored; an empty table gives no rows. A text is hashed and compared as a whole,
however long; a task holds one Arrow batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.common import WHITE, shared_path, staged, utf8

ENTRY = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("run", pa.int64()), ("place", pa.int64())])
TEXT = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("body", pa.binary())])
TEXT_DDL = "key binary, doc_id long, n_chars long, body binary"
ENTRY_DDL = "digest binary, doc_id long, n_chars long, run long, place long"


def normalise(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def _memtable(capacity: int):
    """Sorted runs of at most ``capacity`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            table.sort(key=lambda x: x[0])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(ENTRY, zip(*table, strict=True), strict=True)], schema=ENTRY)

        for batch in batches:
            chars = pa.compute.utf8_length(batch.column(1)).to_pylist()
            for doc_id, text, c in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), chars, strict=True):
                table.append((hashlib.sha256(normalise(text)).digest(), doc_id, c or 0, n, len(table)))
                if len(table) == capacity:
                    yield flush()
                    table, n = [], n + 1
        if table:
            yield flush()

    return run


class HitFilter:
    """A Bloom filter: four bits a key, taken from one 64-bit hash."""

    def __init__(self, keys: DataFrame, most_bytes: int):
        n = keys.count()
        self.words = max(1, min(most_bytes // 8, n // 4 + 1))  # 16 bits a key
        h = F.xxhash64("key")
        word = lambda i: F.pmod(F.shiftrightunsigned(h, 13 * i).bitwiseAND(2**40 - 1), F.lit(self.words))
        bit = lambda i: F.shiftrightunsigned(h, 58 - 6 * i).bitwiseAND(63).cast("int")
        marks = keys.select(F.explode(F.array(*(F.struct(word(i).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(i)).alias("bits")) for i in range(4)))).alias("x"))
        found = marks.groupBy("x.word").agg(F.bit_or("x.bits").alias("bits")).toArrow()  # a number for each word of the filter
        self.bits = np.zeros(self.words, np.int64)
        self.bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        h = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64)
        out = np.ones(len(keys), bool)
        for i in range(4):
            word = (h >> np.uint64(13 * i)) & np.uint64(2**40 - 1)
            bit = (h >> np.uint64(58 - 6 * i)) & np.uint64(63)
            out &= (self.bits[(word % np.uint64(self.words)).astype(np.int64)].view(np.uint64) >> bit) & np.uint64(1) == 1
        return out


def _texts(digest_bytes: int, hits: HitFilter | None = None):
    """Rows of ``TEXT``; with ``hits`` those that may be hits, one of equal bodies within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [normalise(x) for x in utf8(batch.column(1))]
            key = [hashlib.sha256(x).digest()[:digest_bytes] for x in body]
            if hits:
                may = hits.may_hold(key)
                at = sorted({body[i]: i for i in reversed(np.flatnonzero(may).tolist())}.values())
                batch, body, key = batch.take(pa.array(at, pa.int64())), [body[i] for i in at], [key[i] for i in at]
            chars = pa.compute.utf8_length(batch.column(1)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), batch.column(0), chars, pa.array(body, pa.binary())], schema=TEXT)

    return run


class DigestIndex:
    """An index in the folder that all executors share. ``parts`` are its (level, number), of which 0 are runs that are not yet merged.

    Opened on a folder that holds an index, it goes on from the last version.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest_bytes: int = 32, capacity: int = 200_000, fanout: int = 4):
        self.spark, self.path, self.digest_bytes, self.capacity, self.fanout = spark, path or shared_path(spark, "digests"), digest_bytes, capacity, fanout
        self.version, self.parts, self.flushed = 0, [], 0
        if path:
            try:
                known = spark.read.schema("version long, level int, number int, flushed int").parquet(f"{path}/manifest").orderBy(F.col("version").desc()).collect()  # a row a part and version
            except AnalysisException:
                known = []
            if known:
                self.version, self.flushed = known[0]["version"], known[0]["flushed"]
                self.parts = sorted((r["level"], r["number"]) for r in known if r["version"] == self.version)

    def _commit(self, parts: list[tuple[int, int]]) -> None:
        self.version, self.parts = self.version + 1, sorted(parts)
        rows = [(self.version, level, number, self.flushed) for level, number in self.parts]
        self.spark.createDataFrame(rows, "version long, level int, number int, flushed int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def flush(self, docs: DataFrame) -> None:
        """Adds (doc_id, text) rows as sorted runs."""
        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        entries = rows.mapInArrow(_memtable(self.capacity), ENTRY_DDL)
        row = F.struct(F.lit(self.flushed).alias("flush"), F.spark_partition_id().cast("long").alias("task"), "run", "place").alias("row")
        entries.select("digest", "doc_id", "n_chars", row).write.mode("overwrite").parquet(f"{self.path}/runs/{self.flushed}")
        self.flushed += 1
        self._commit([*self.parts, (0, self.flushed - 1)])

    def entries(self, numbers: list[int] | None = None) -> DataFrame:
        """The rows of these flushes, or of all, with ``key``, the part of the digest that the index compares."""
        schema = "digest binary, doc_id long, n_chars long, row struct<flush: int, task: long, run: long, place: long>"
        paths = [f"{self.path}/runs/{n}" for n in (range(self.flushed) if numbers is None else numbers)]
        found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found.withColumn("key", F.substring("digest", 1, self.digest_bytes))

    def compact(self) -> DataFrame:
        """Merges runs and, where ``fanout`` parts of a level have gathered, levels; then ``level``."""
        runs = [n for level, n in self.parts if not level]
        if runs:
            best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("inv"), F.col("row").alias("row"))).alias("best")
            self._replace([(0, n) for n in runs], 1, self.entries(runs).groupBy("key").agg(F.count("*").alias("size"), best))
        level = 1
        while len(full := [p for p in self.parts if p[0] == level]) >= self.fanout:
            self._replace(full, level + 1, self._merged(full))
            level += 1
        return self.level()

    def _replace(self, old: list[tuple[int, int]], level: int, merged: DataFrame) -> None:
        number = max(n for _, n in old)  # flushes up to this one are in the part
        merged.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/level{level}/{number}")
        self._commit([*(p for p in self.parts if p not in old), (level, number)])

    def _merged(self, parts: list[tuple[int, int]]) -> DataFrame:
        schema = "key binary, size long, best struct<n_chars: long, inv: long, row: struct<flush: int, task: long, run: long, place: long>>"
        if not parts:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*(f"{self.path}/level{level}/{n}" for level, n in parts))
        return found if len(parts) == 1 else found.groupBy("key").agg(F.sum("size").alias("size"), F.max("best").alias("best"))

    def level(self) -> DataFrame:
        """What is merged so far: a row per key, with its size and the entry that stays."""
        return self._merged([p for p in self.parts if p[0]])

    def collided(self, docs: DataFrame, filter_bytes: int = 1 << 24) -> DataFrame:
        """Byte verification of the hits: the keys that stand for more than one text."""
        hits = staged(self.level().filter("size > 1").select("key"), "hits")
        texts = self.bodies(docs, HitFilter(hits, filter_bytes)).join(hits, "key", "left_semi").groupBy("key", "body").agg(F.count("*").alias("n"))
        return texts.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1").select("key")

    def bodies(self, docs: DataFrame, hits: HitFilter | None = None) -> DataFrame:
        """Key, entry columns and normalised text of each document; with ``hits`` of those that may be hits, of equal ones one from each batch."""
        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_texts(self.digest_bytes, hits), TEXT_DDL)


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, capacity: int = 200_000, filter_bytes: int = 1 << 24) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, n_chars, text_sha256.

    ``capacity`` bounds a memtable; ``digest_bytes`` is how much of the SHA-256 the index compares (a
    short key makes collisions, which verification then resolves); ``filter_bytes`` bounds the filter that
    goes to all tasks.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, digest_bytes=digest_bytes, capacity=capacity)
    index.flush(docs)
    level = index.compact()
    collided = staged(index.collided(docs, filter_bytes), "collided")
    columns = ["doc_id", F.bitwise_not("best.inv").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "n_chars"]
    joined = index.entries().join(level, "key")
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    if not collided.take(1):
        return joined.select(*columns, digest)
    rows = staged(index.bodies(docs).join(collided, "key", "left_semi").withColumn("row", F.monotonically_increasing_id()), "collided-rows")
    best = rows.groupBy("body").agg(F.count("*").alias("size"), F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("inv"), "row")).alias("best"))
    apart = rows.join(best, "body").select(*columns, F.sha2("body", 256).alias("text_sha256"))
    return joined.join(collided, "key", "left_anti").select(*columns, digest).unionByName(apart)


def keep_one(docs: DataFrame, digest_bytes: int = 32, capacity: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of_row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256).alias("text_sha256"))
    kept = exact_dedup(docs, digest_bytes, capacity).filter("kept").select(F.xxhash64("doc_id", "text_sha256").alias("_at"), F.struct("doc_id", "n_chars", "text_sha256").alias("_kept"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), of_row.alias("of")).withColumn("at", F.xxhash64("of.doc_id", "of.text_sha256"))
    found = rows.join(kept, (F.col("at") == F.col("_at")) & F.col("of").eqNullSafe(F.col("_kept")), "left_semi")
    return found.dropDuplicates(["of"]).select("row.*")
