"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Every stage but the last returns the columns of documents. Stages share their executors, so that each bounds its Arrow batches. Rows without a doc_id pass near dedup, which
tells rows apart by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultlens.llm import exact_dedup, language_id, ngram_join, packing, quality
from faultlens.llm.common import discard, small_batches, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that were learned, and those without letters, go."""
    small_batches(spark)
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents with equal texts stays."""
    small_batches(spark)
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by shingles of five words and a similarity of 0.8 or more, the one with the smallest id stays.

    A document is an id: where several rows have one, the least of their texts is compared, and all of them stay or go.
    """
    small_batches(spark)
    found = ngram_join.jaccard_components(docs, words=5, threshold=(80, 100))
    stay = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(docs.columns).union(docs.filter("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of 8192 code points."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near_duplicates), ("best_fit_packing", packed)]

#: The label model's expectation-maximisation has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)  # if a stage wrote it
    return docs
