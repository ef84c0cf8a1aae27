"""English full-text search over errors: lexemes, an inverted index by lexeme, and its intersection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.stem import STOP_WORDS, lexeme

TOKEN = r"[\p{L}\p{N}]+"
#: Folders of an index; a search reads those of its lexemes.
BUCKETS = 64


def searched_text(logs: DataFrame) -> Column:
    """What is searched: message, back trace and error type, as far as there are any."""
    return F.concat_ws(" ", *[F.col(c) for c in ("message", "backtrace", "error_type") if c in logs.columns])


def _lexemes(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str | None] = {}
    for batch in tokens:
        if len(known) > 200_000:
            known.clear()
        distinct = batch.unique()
        known.update((t, lexeme(t)) for t in distinct if t not in known)
        yield batch.map(known).astype(object)


def of_query(query: str) -> list[str]:
    """The distinct lexemes of a query; none if it has stop words only."""
    tokens = re.findall(r"[^\W_]+", query.lower())
    return sorted({x for t in tokens if (x := lexeme(t)) is not None})


def lexemes(logs: DataFrame) -> DataFrame:
    """(lexeme, id): each lexeme of an error once. Words are runs of letters and digits, lower-cased; long ones are cut at 100 signs."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(searched_text(logs)), F.lit(f"({TOKEN})")))
    each = logs.filter("id is not null").select("id", F.explode(tokens).alias("token")).select("id", F.substring("token", 1, 100).alias("token"))
    stemmed = F.pandas_udf(_lexemes, "string")
    found = each.filter(~F.col("token").isin(sorted(STOP_WORDS))).select(stemmed("token").alias("lexeme"), "id")
    return found.filter("lexeme is not null").distinct()


def bucket(column: Column | str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def write_index(logs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The inverted index of errors: (lexeme, id) sorted within folders by bucket. A lexeme of very many errors is spread over several files."""
    rows = lexemes(logs).withColumn("bucket", bucket("lexeme"))
    rows.repartitionByRange("bucket", "lexeme", "id").sortWithinPartitions("bucket", "lexeme", "id").write.mode(mode).partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    return spark.read.schema(f"lexeme string, id {id_type}, bucket int").parquet(path)


def search(index: DataFrame, query: str) -> DataFrame:
    """(id) of the errors that have all lexemes of the query; none if it has no lexeme."""
    asked = of_query(query)
    if not asked:
        return index.select("id").limit(0)
    buckets = [r[0] for r in index.sparkSession.createDataFrame([(x,) for x in asked], "x string").select(bucket("x")).distinct().collect()]  # of the query's words
    rows = index.filter(F.col("bucket").isin(buckets) & F.col("lexeme").isin(asked)).select("id", "lexeme").distinct()
    return rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked)).select("id")


def matches(query: str, text: Column) -> Column:
    """Whether a text has all lexemes of the query, without an index; false if the query has none."""
    asked = set(of_query(query))
    if not asked:
        return F.lit(False)

    def hit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            known: dict[str, str | None] = {}
            found = []
            for one in batch:
                tokens = {t[:100] for t in re.findall(r"[^\W_]+", (one or "").lower())}
                known.update((t, lexeme(t)) for t in tokens if t not in known)
                found.append(asked <= {known[t] for t in tokens})
            yield pd.Series(found, dtype=bool)

    return F.pandas_udf(hit, "boolean")(text)
