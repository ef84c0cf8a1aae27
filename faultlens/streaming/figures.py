"""Live figures: the rows that changed and the day's totals, from one stream of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.streaming.store import OCCURRED

#: What each outcome adds to the figures of its day.
ADDS = {"occurrences": OCCURRED, "new_errors": ("created",), "reopened": ("reopened",), "resolved": ("resolve",)}
_ROW = ["application_id", "error_hash", "occurrence_count", "resolved", "status", "muted", "first_us", "last_us"]


def live_figures(outcomes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(day, kind, target, action, value, row) of what changes, for a query in update mode.

    kind ``row``: an error as its last outcome of the day left it, as JSON, ``prepend`` if it began today's list and ``replace`` else. kind
    ``figure``: the day's total of one of ``ADDS``, and of ``open``, by how many more errors are open than when the day began. A day's rows and totals are state
    until the watermark has passed it, and nothing of earlier days.
    """
    rows = outcomes.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    opened = F.when(F.col("outcome").isin("created", "reopened"), 1).when(F.col("outcome") == "resolve", -1).otherwise(0)
    figures = [F.struct(F.lit("figure").alias("kind"), F.lit(n).alias("target"), F.when(F.col("outcome").isin(*kinds), 1).otherwise(0).cast("long").alias("adds")) for n, kinds in ADDS.items()]
    figures.append(F.struct(F.lit("figure").alias("kind"), F.lit("open").alias("target"), opened.cast("long").alias("adds")))
    own = F.struct(F.lit("row").alias("kind"), F.col("error_log_id").cast("string").alias("target"), F.lit(1).cast("long").alias("adds"))
    each = rows.select("at", "seq", "outcome", F.to_json(F.struct(*_ROW)).alias("row"), F.explode(F.filter(F.array(own, *figures), lambda x: x["adds"] != 0)).alias("x"))
    is_row = F.col("x.kind") == "row"
    per = each.groupBy(F.window("at", "1 day").alias("w"), F.col("x.kind").alias("kind"), F.col("x.target").alias("target")).agg(
        F.sum("x.adds").alias("value"),
        F.max(F.when(is_row, F.struct("seq", "row"))).alias("last"),
        F.bool_or(is_row & (F.col("outcome") == "created")).alias("began"),
    )
    action = F.when(F.col("kind") == "figure", "stats").when(F.col("began"), "prepend").otherwise("replace")
    return per.select(F.to_date("w.start").alias("day"), "kind", "target", action.alias("action"), F.when(F.col("kind") == "figure", F.col("value")).alias("value"), F.col("last.row").alias("row"))
