"""Bounded samples of labelled documents, for fitting classifiers. Rows whose crc32(doc_id as text) mod 5 is 0 are never in one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, fold: int = 0) -> Column:
    """crc32(doc_id as text) mod folds = fold; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int) -> DataFrame:
    """text, label of at most `each` documents of either label (0, 1), in the order of a hash of doc_id.

    Rows with a null doc_id or label take no part; of several labels of a document the highest counts, of several rows
    of a doc_id the one whose text has the least hash. So there are never more than 2 * each rows. Null texts stay null.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    few = reduce(DataFrame.union, (known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for k in (0, 1)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(few), "doc_id")  # at most 2 * each labels
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"), F.first("label").alias("label")).select("doc_id", F.col("t.text").alias("text"), "label")
