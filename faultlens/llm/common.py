"""Helpers that several operators share: the shared folder, staged tables, Arrow batches, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: the class [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"


#: What ``shared_path`` names.
_OURS = re.compile(r"/faultlens/[\w-]+-[0-9a-f]{32}/[^/]+$")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Set here only where the session has none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        own = tempfile.mkdtemp(prefix="faultlens-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/faultlens/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``staged`` wrote, once nothing reads it any more."""
    jvm, files = df.sparkSession.sparkContext._jvm, df.inputFiles()
    if files and _OURS.search(files[0]):
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of an Arrow batch, as whole texts are long.
BATCH = 1024
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches at ``BATCH`` rows where the session has larger ones: both a task's JVM and its Python hold one as a whole."""
    rows = int(spark.conf.get(_RECORDS))
    if rows <= 0 or rows > BATCH:
        spark.conf.set(_RECORDS, str(BATCH))


def per_batch(make: Callable[[pa.RecordBatch], dict[str, object]], schema: pa.Schema):
    """A mapInArrow function from a function of one batch to columns in ``schema``'s order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = make(batch)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def place(column: str) -> Column:
    """A hash of a column as a number from 0 to below 1: rows below ``k / n`` are about k of n."""
    return F.pmod(F.xxhash64(column), F.lit(2**53)) / float(2**53)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long), as (id, component): the smallest id reachable.

    Alternating large-star and small-star rounds: every round is two aggregations and two joins over
    the edges, its result is written to the shared folder, and no neighbour list is ever gathered.
    Nulls are ignored. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    cur = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        nxt = staged(small, name)
        # settled: every node hangs on exactly one smaller node, which hangs on none
        sums = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        old = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(cur)
        cur = nxt
        if (sums.n, sums.h) == (old.n, old.h):
            break
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
