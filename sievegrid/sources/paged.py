"""Rows kept in an order, so that any page of them is read from the few files that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class PagedTable:
    """Rows in ranges of an order, with the number of rows of each range and each value of `by`.

    A page is found from those numbers: whatever its number, only the ranges it lies in are read and sorted.
    """

    def __init__(self, spark: SparkSession, folder: str, by: str | None = None):
        self.spark, self.folder, self.by = spark, folder, by

    def build(self, rows: DataFrame, order: list[Column], parts: int) -> PagedTable:
        """order: must tell all rows apart, or pages may share rows that tie. parts: ranges; a page reads about one of them."""
        keys = ["_part", *([self.by] if self.by else [])]
        ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
        ranged.write.partitionBy("_part").parquet(f"{self.folder}/rows")
        self.spark.read.parquet(f"{self.folder}/rows").groupBy(*keys).agg(F.count("*").alias("n")).write.parquet(f"{self.folder}/index")
        return self

    def _counts(self, value: str | None) -> DataFrame:
        counts = self.spark.read.parquet(f"{self.folder}/index")
        counts = counts if value is None else counts.filter(F.col(self.by) == value)
        return counts.groupBy("_part").agg(F.sum("n").alias("n"))  # a row for each range

    def total(self, value: str | None = None) -> int:
        return self._counts(value).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, order: list[Column], number: int, size: int, value: str | None = None) -> DataFrame:
        """The rows of one page, numbered from 1, of those whose `by` is value, or of all."""
        if number < 1 or not 1 <= size <= 100:
            raise ValueError("page numbers start at 1, and a page has 1 to 100 rows")
        first = (number - 1) * size
        before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = self._counts(value).withColumn("before", before).filter((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect()  # at most `size` ranges
        rows = self.spark.read.parquet(f"{self.folder}/rows").filter(F.col("_part").isin([r["_part"] for r in held]) if held else F.lit(False))
        rows = rows if value is None else rows.filter(F.col(self.by) == value)
        return rows.drop("_part").orderBy(*order).offset(first - min((r["before"] for r in held), default=first)).limit(size)


def clustered(df: DataFrame, path: str, name: str, key: str, buckets: int) -> DataFrame:
    """The rows as a table in buckets of the key, sorted by it: groups and joins by the key need no shuffle. name: a new one in the session's catalogue."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
