"""What the operators share: written tables in the shared folder, and running totals without one big task."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.llm.textbytes import slices, tidy


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see. Where it is unset, a local one on a local master, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a parquet table in the shared folder: lineage is cut, and a lost executor costs no earlier work."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_path", None):
            remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with: it does so only when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


#: Rows of a bucket of running totals.
BUCKET_ROWS = 20_000


#: Rows of a batch of texts on its way to a Python worker; batches of Spark's usual size hold tens of megabytes on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in small batches, in all later plans of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


#: A key on more than one of so many rows is hot; there are at most that many such keys, so a table of them can be broadcast.
HOT = 1000


def joined(rows: DataFrame, table: DataFrame, key: str, often: str, total: int) -> DataFrame:
    """rows joined with table on key, of which table has a row each and `often` tells how many rows have it; total: of rows.

    Hot keys, HOT at most, are looked up by a broadcast where their rows are, so no task gets all rows of one; the others are shuffled.
    """
    limit = total // HOT
    hot, cold = table.filter(F.col(often) > limit).drop(often), table.filter(F.col(often) <= limit).drop(often)
    few = rows.join(F.broadcast(hot), key)  # at most HOT keys
    return few.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def running_totals(df: DataFrame, key: str, order: list[str], amount: Column, total: str, buckets: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds column `total`: the sum of `amount` over the rows of the same key that come before, ordered by the bucket and then by `order`.

    A key may hold most of the rows: they are dealt over hash buckets of `order`, one for each BUCKET_ROWS rows and 512 at least, or
    over the buckets given, that are summed apart, and only one row for each key and bucket is ordered by key alone.
    """
    if buckets is None and bucket is None:
        buckets = max(512, df.count() // BUCKET_ROWS)
    cut = df.withColumn("_amount", amount).withColumn("_bucket", bucket_of(order, buckets) if bucket is None else bucket)
    sums = cut.groupBy(key, "_bucket").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    out = cut.join(bases, cut[key].eqNullSafe(bases["_key"]) & (cut["_bucket"] == bases["_b"]))
    return out.withColumn(total, F.col("_base") + F.col("_inside")).drop("_amount", "_bucket", "_key", "_b", "_base", "_inside")


def filtered(docs: DataFrame, keep, rows: int = 4096) -> DataFrame:
    """The rows of docs whose text passes: keep(column of at most so many texts) gives a boolean for each.

    Columns stay as they are, whatever their names; rows that repeat pass or go together; null texts are given as such.
    An empty table gives no rows.
    """
    at = docs.columns.index("text")

    def sift(batches):
        for batch in batches:
            for a, b in slices(batch.column(at), rows=rows):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(keep(part.column(at))))

    return docs.mapInArrow(tidy(sift), docs.schema)
