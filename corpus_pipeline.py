"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Rows with nulls in any column go through all stages: a null text is a text without words, is not toxic for that, and scores
0 for quality where anyone votes. Rows that repeat or share a doc_id count each by itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievegrid.llm import minhash_join, mixing, packing, quality_knn, toxicity
from sievegrid.llm.shared import documents, dropped, small_batches, written


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    small_batches(spark)
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filtered(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality voters do not reject."""
    small_batches(spark)
    model = quality_knn.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_knn.filtered(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return minhash_join.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources; a document taken twice is there twice."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("toxicity", non_toxic), ("quality", good_quality), ("near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: The stages train models and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, and dropped when the next one is there."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
