"""The query over the full-text index, with the same in SQL over the lexemes that its sentences have."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalog import LOGS
from faultlens.operators import fulltext
from faultlens.sources import driver
from faultlens.sources.folders import shared_path

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: Messages by k, and the lexemes that the english configuration of a full-text search gives them.
SENTENCES = [
    ("Connection refused while connecting to the cache", ["connect", "refus", "cach"]),
    ("connections were refusing", ["connect", "refus"]),
    ("Timed out waiting for connected clients", ["time", "wait", "connect", "client"]),
    ("Universities and university caches", ["univers", "cach"]),
    ("The connector was happily refused", ["connector", "happili", "refus"]),
    (None, []),
    ("Refusal of a CONNECTION: agreed, controlling", ["refus", "connect", "agre", "control"]),
]
SEARCHES = {"connecting refuses": ["connect", "refus"], "the cache": ["cach"], "of the": [], "clients, WAIT": ["client", "wait"], "argumenterror connects": ["argumenterror", "connect"], "error": ["error"]}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(s) for s, _ in SENTENCES]), (F.col("k") % len(SENTENCES) + 1).cast("int"))
    return driver.error_logs(spark, d).select("id", "error_type", said.alias("message"))


def _searched(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "lexemes")
    fulltext.write_index(_texts(spark, d), path)
    index = fulltext.read_index(spark, path)
    found = [fulltext.search(index, q).select(F.lit(q).alias("query"), "id") for q in SEARCHES]
    return reduce(DataFrame.unionByName, found)


_OF_K = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in lexemes) + "]::varchar[]" for _, lexemes in SENTENCES) + "]"
_ASKED = ", ".join(f"('{q}', [{', '.join(repr(x) for x in lexemes)}]::varchar[])" for q, lexemes in SEARCHES.items())
# of the error types' own words only these are asked for
ENTRIES["b5_fulltext_search"] = (
    _searched,
    f"""with {LOGS}, t as (
  select id, list_concat({_OF_K}[k % {len(SENTENCES)} + 1], case error_type when 'ArgumentError' then ['argumenterror'] when 'Timeout::Error' then ['error'] else []::varchar[] end) as words from logs
), q(query, asked) as (values {_ASKED})
select query, id from t join q on len(asked) > 0 and list_has_all(words, asked)""",
)
