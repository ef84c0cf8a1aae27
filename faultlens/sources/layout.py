"""Error tables on disk: a folder a day, so that windows and retention touch folders only, and co-bucketed tables for eager loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.windows import days, scoped
from faultlens.sources.folders import shared_path

DATE = "occurred_date"


def _put(rows: DataFrame, path: str, order: list[str]) -> None:
    # by ranges, so that a day of very many rows is several tasks and files
    dealt = rows.repartitionByRange(DATE, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(path)


def write_daily(logs: DataFrame, path: str, of: str = "occurred_at") -> None:
    """Writes errors by day; days that ``path`` has and ``logs`` hasn't stay. Rows without a time have a folder of their own."""
    _put(logs.withColumn(DATE, F.to_date(of)), path, [of])


def write_children(table: DataFrame, logs: DataFrame, path: str, of: str = "error_log_id") -> None:
    """Writes occurrences or comments by the day of their error, so that they go with it. Those of unknown errors have the folder of no day."""
    day = logs.select(F.col("id").alias(of), F.to_date("occurred_at").alias(DATE))
    _put(table.join(day, of, "left"), path, [of])


def read_daily(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``schema``: of the columns without the day, which is the folder's."""
    return spark.read.schema(f"{schema}, {DATE} date").parquet(path)


def since_daily(logs: DataFrame, as_of: Column, n: float, application: int | list[int] | None = None) -> DataFrame:
    """``windows.since`` of a table by day: only the days of the window are read."""
    start = as_of - days(n)
    return scoped(logs, application).filter((F.col(DATE) >= F.to_date(start)) & (F.col("occurred_at") >= start)).drop(DATE)


def changed(spark: SparkSession, path: str, schema: str, first: str, last: str, change: Callable[[DataFrame], DataFrame], of: str = "occurred_at") -> None:
    """Rewrites the days from ``first`` to ``last`` by a change of their rows; other days aren't read or written.

    The change's rows are written aside first, so that no day is lost if the job fails. A day without rows left keeps no folder.
    """
    touched = F.col(DATE).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    before = read_daily(spark, path, schema).filter(touched)
    aside = shared_path(spark, "days")
    change(before).write.partitionBy(DATE).parquet(aside)
    after = read_daily(spark, aside, schema)
    _drop(spark, path, [str(r[0]) for r in before.select(DATE).distinct().join(after.select(DATE).distinct(), DATE, "left_anti").collect()])  # days
    _put(after, path, [of])


def _drop(spark: SparkSession, path: str, folders: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for day in folders:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{DATE}={day}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def retained_daily(spark: SparkSession, tables: dict[str, tuple[str, str, str]], as_of: str, n: int = 90) -> dict[str, int]:
    """Deletes errors older than n days, and what refers to them: whole days as folders, of the day of the cut the older rows.

    ``tables``: name -> (path, schema, column with error ids), the errors as ``error_logs`` with their ``id``; the others as written by
    ``write_children``, or with several columns, comma-joined, if their rows refer to several errors (these are compared by ids).
    Returns how many days were deleted of each. Errors without a time stay.
    """
    cut = F.lit(as_of).cast("timestamp_ntz") - days(n)
    cut_day = F.to_date(cut)
    path, schema, _ = tables["error_logs"]
    logs = read_daily(spark, path, schema)
    edge = str(spark.range(1).select(cut_day).first()[0])
    old = logs.filter((F.col(DATE) == cut_day) & (F.col("occurred_at") < cut)).select("id")
    gone = logs.filter((F.col(DATE) < cut_day) | ((F.col(DATE) == cut_day) & (F.col("occurred_at") < cut))).select("id")
    dropped = {}
    # children first, while the errors still say which are old
    for name, (at, columns, of) in sorted(tables.items(), key=lambda t: t[0] == "error_logs"):
        table = read_daily(spark, at, columns)
        refers = of.split(",")
        if len(refers) > 1:
            left = table
            for c in refers:
                left = left.join(gone.withColumnRenamed("id", c), c, "left_anti")
            aside = shared_path(spark, "edges")
            left.write.partitionBy(DATE).parquet(aside)
            whole = [str(r[0]) for r in table.select(DATE).distinct().collect() if r[0] is not None]  # days
            kept = read_daily(spark, aside, columns)
            _drop(spark, at, whole)
            _put(kept, at, refers[:1])
            dropped[name] = 0
            continue
        before = [str(r[0]) for r in table.filter(F.col(DATE) < cut_day).select(DATE).distinct().collect()]  # days
        _drop(spark, at, before)
        changed(spark, at, columns, edge, edge, lambda t, c=of: t.join(old.withColumnRenamed("id", c), c, "left_anti").select(t.columns), of)
        dropped[name] = len(before)
    return dropped


def bucketed(table: DataFrame, by: str, n: int = 64) -> DataFrame:
    """A table in the shared folder, dealt to ``n`` buckets by a column and sorted by it; two of the same n join by these columns without a shuffle."""
    spark = table.sparkSession
    path = shared_path(spark, "buckets")
    name = "faultlens_" + path.rsplit("-", 1)[-1]
    table.write.format("parquet").bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # only the catalog's entry: the files stay, and the relation knows its buckets
    return out


def eager_loaded(logs: DataFrame, comments: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Errors with the number of their comments and the last one's text, and of their occurrences and the last one's time.

    Where all three are ``bucketed`` by the error's id no table is shuffled.
    """
    of = F.col("error_log_id").alias("id")
    said = comments.groupBy(of).agg(F.count("*").alias("comments"), F.max_by("body", F.struct("created_at", "body")).alias("last_comment"))
    seen = occurrences.groupBy(of).agg(F.count("*").alias("occurrences"), F.max("occurred_at").alias("last_occurrence"))
    out = logs.join(said, "id", "left").join(seen, "id", "left")
    return out.withColumns({"comments": F.coalesce("comments", F.lit(0)), "occurrences": F.coalesce("occurrences", F.lit(0))})
