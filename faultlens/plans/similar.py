"""Similar errors: candidates by blocking, then a score of frames and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.numbers import round_half_up
from faultlens.functions.text import frame_similarity, frames, message_similarity, similarity_message


#: How many candidates each block gives.
BLOCKS = {1: 50, 2: 30, 3: 20}


def candidates(logs: DataFrame, error_id: int) -> DataFrame:
    """By the same back trace signature (50), the same type (30), and the same platform with a like type (20), by id; with the asked error's
    columns as ``_backtrace``, ``_message`` and ``_platform``.

    A later block is asked only while the earlier ones have fewer than 20. One scan numbers the rows' blocks; their limits by rank are
    applied within each task, before the shuffle of the few rows that remain.
    """
    names = ["backtrace_signature", "error_type", "platform", "backtrace", "message"]
    one = logs.filter(F.col("id") == error_id).agg(F.min(F.struct(*names)).alias("x")).select(*[F.col(f"x.{c}").alias(f"_{c}") for c in names])
    stem = F.regexp_extract("_error_type", "^([A-Z][a-z]+)", 1)
    same_trace = F.col("backtrace_signature") == F.col("_backtrace_signature")
    alike = (F.col("platform") == F.col("_platform")) & (stem != "") & F.col("error_type").startswith(stem)
    block = F.when(same_trace, 1).when(F.col("error_type") == F.col("_error_type"), 2).when(alike, 3)
    rows = logs.filter(F.col("id") != error_id).join(F.broadcast(one)).withColumn("_block", block).filter("_block is not null")
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy("id"))).filter(F.col("_at") <= max(BLOCKS.values()))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in BLOCKS.items() for x in pair]), F.col("_block"))
    found = ranked.filter(F.col("_at") <= limit)
    few = Window.partitionBy(F.lit(0))  # a hundred rows at most
    counted = found.withColumn("_n1", F.count_if(F.col("_block") == 1).over(few)).withColumn("_n2", F.count_if(F.col("_block") == 2).over(few))
    use = (F.col("_block") == 1) | ((F.col("_block") == 2) & (F.col("_n1") < 20)) | ((F.col("_block") == 3) & (F.col("_n1") < 20) & (F.col("_n1") + F.col("_n2") < 20))
    return counted.filter(use).drop("_n1", "_n2", "_block", "_at", "_backtrace_signature", "_error_type")


def score(backtrace_a: Column, backtrace_b: Column, message_a: Column, message_b: Column, platform_a: Column, platform_b: Column) -> Column:
    """0.7 frames and 0.3 message; nothing across known, different platforms."""
    both = 0.7 * frame_similarity(frames(backtrace_a), frames(backtrace_b)) + 0.3 * message_similarity(similarity_message(message_a), similarity_message(message_b))
    return F.when(platform_a.isNotNull() & platform_b.isNotNull() & (platform_a != platform_b), 0.0).otherwise(both)


def similar_errors(logs: DataFrame, error_id: int, threshold: float = 0.6, limit: int = 10) -> DataFrame:
    s = round_half_up(score(F.col("backtrace"), F.col("_backtrace"), F.col("message"), F.col("_message"), F.col("platform"), F.col("_platform")), 3)
    rows = candidates(logs, error_id).select("id", "error_type", s.alias("similarity"))
    return rows.filter(F.col("similarity") >= threshold).orderBy(F.col("similarity").desc(), "id").limit(limit)
