"""Best-fit packing of documents into sequences, with conflicts.

No two documents of one source, nor of one duplicate cluster, share a bin. Documents are dealt to shards
by a hash of the row, so that hot sources spread evenly and bins don't depend on how the table is split; each shard is packed by itself, in descending
order of length. Its bins are ordered by what is left in them and carry a bitmap of their sources and
clusters; the search starts at the successor of the length and goes on until the tightest bin that
conflicts with nothing is found, else a bin is opened. There is no bound on bins or on the search.

Defined results: a text longer than a bin fills whole bins by itself and its rest is packed as a piece;
a null or empty text is one piece of length 0; a null source or cluster conflicts with nothing; rows
that repeat are packed as often as they occur; a null doc_id is packed like any other; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies of a row that go to one shard.
LOT = 64
PACKED = "doc_id long, piece int, start long, length long, bin_id long"


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bins of (length, source, cluster) items, in the order given."""
    bit: dict[tuple[str, object], int] = {}
    often = Counter(c for _, _, c in items if c is not None)
    left: list[tuple[int, int]] = []  # (room, bin), ascending
    masks: list[int] = []
    out = []
    for length, source, cluster in items:
        mask = 0
        if source is not None:
            mask |= 1 << bit.setdefault(("source", source), len(bit))
        if cluster is not None and often[cluster] > 1:
            mask |= 1 << bit.setdefault(("cluster", cluster), len(bit))
        at = bisect_left(left, (length, -1))
        while at < len(left) and masks[left[at][1]] & mask:
            at += 1
        if at < len(left):
            room, b = left.pop(at)
        else:
            room, b = capacity, len(masks)
            masks.append(0)
        masks[b] |= mask
        insort(left, (room - length, b))
        out.append(b)
    return out


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].sort_values(["length", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], na_position="last", kind="stable")
        plain = lambda c: [None if pd.isna(x) else x for x in pdf[c]]
        bins = best_fit(list(zip(pdf["length"].tolist(), plain("source"), plain("cluster"), strict=True)), capacity)
        return pdf[["doc_id", "piece", "start", "length"]].assign(bin_id=pdf["shard"].to_numpy() * 2**32 + bins)

    return run


def pack(docs: DataFrame, capacity: int = 8192, shard_items: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, bin_id for each piece of ``docs`` (doc_id, length, source, cluster).

    ``shard_items`` is how many pieces a shard has on average, so that documents of very many pieces are spread too.
    """
    items = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("whole"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    last = F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0)).cast("int")
    shards = max(1, -(-(items.agg(F.sum(last.cast("long") + 1)).first()[0] or 0) // shard_items))
    rows = items.groupBy("doc_id", "whole", "source", "cluster").agg(F.count("*").alias("n"))
    # copies of a row are dealt in lots, which are rows of their own only within a shard
    lots = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT)))).withColumn("copies", F.least(F.lit(LOT), F.col("n") - F.col("lot") * LOT))
    pieces = lots.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("length", F.least(F.col("whole") - F.col("start"), F.lit(capacity).cast("long")))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "whole", "source", "cluster", "lot"), F.lit(shards)).cast("long"))
    return dealt.drop("whole", "n", "lot").groupBy("shard").applyInPandas(_pack(capacity), PACKED)


def pack_documents(docs: DataFrame, capacity: int = 8192, shard_items: int = 4096) -> DataFrame:
    """The same over (doc_id, text, source): length in code points, clusters of texts equal but for white space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cluster = F.when(F.length(text) > 0, F.md5(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")))
    return pack(docs.select("doc_id", F.length(text).alias("length"), "source", cluster.alias("cluster")), capacity, shard_items)
