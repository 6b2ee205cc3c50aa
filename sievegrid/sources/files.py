"""Text and table files of message collections."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see; a local one only on a local master where none is named, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the folder that all executors see, for what several jobs or both sides of a join read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of this application's that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: it does so only when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: StructType, corrupt: bool = False) -> DataFrame:
    """One record a line, by an explicit schema; blank lines don't count, fields of broken lines are null. corrupt: column _corrupt has the broken lines."""
    if corrupt:
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.filter(F.col(CORRUPT).isNull() | (F.trim(CORRUPT) != "")) if corrupt else rows


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


#: Bytes of the longest record; beyond it a quote was never closed.
MOST_RECORD = 64 << 20


def _before(amount: str, total: str):
    """A step that adds `total`: the sum of `amount` over the lines of the same file that come before. Lines are summed by blocks of the file, and blocks in their order."""
    block = Window.partitionBy("_file", "_block")
    inside = F.coalesce(F.sum(amount).over(block.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def add(lines: DataFrame) -> DataFrame:
        sums = lines.groupBy("_file", "_block").agg(F.sum(amount).alias("_sum"))  # a row for each split of a file
        blocks = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("_file", "_block", F.coalesce(F.sum("_sum").over(blocks), F.lit(0)).alias("_base"))
        return lines.join(bases, ["_file", "_block"]).withColumn(total, F.col("_base") + inside).drop("_base")

    return add


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """number, record of the files of a quoted CSV with headers: each record as text, numbered from 0 over all files in the order of their names.

    A quoted field may hold line breaks. Lines are read by as many tasks as the files have splits; a line begins a record where the
    quotes before it in its file are even in number, which running sums over splits tell. So no task reads more than its split, and
    only the lines of records over several lines are gathered. Blank lines are no records, headers and byte order marks are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    kept = scratch(spark, "lines")
    lines.withColumn("_quotes", (F.length("value") - F.length(F.translate("value", '"', ""))).cast("long")).write.parquet(kept)  # splits stay as they are from here on
    lines = _before("_quotes", "_open")(spark.read.parquet(kept))
    start = (F.col("_open") % 2 == 0) & ~F.col("value").isin("", "\r")
    inside = F.col("_open") % 2 == 1
    lines = lines.filter(start | inside).withColumn("_start", start.cast("long"))
    lines = _before("_start", "_earlier")(lines).withColumn("_record", F.col("_earlier") + F.col("_start") - 1)
    alone = (F.col("_start") == 1) & (F.col("_quotes") % 2 == 0)
    several = lines.filter(~alone)
    longest = several.groupBy("_file", "_record").agg(F.sum(F.octet_length("value") + 1).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest > MOST_RECORD:
        raise ValueError(f"a record of {longest} bytes: a quote is not closed")
    in_order = F.array_sort(F.collect_list(F.struct("_block", "_at", "value")))  # at most MOST_RECORD bytes
    joined = several.groupBy("_file", "_record").agg(F.array_join(F.transform(in_order, lambda x: x["value"]), "\n").alias("value"))
    records = lines.filter(alone).select("_file", "_record", "value").unionByName(joined)
    counts = lines.groupBy("_file").agg(F.sum("_start").alias("n"))
    bases = counts.select("_file", (F.coalesce(F.sum(F.col("n") - 1).over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1).alias("_base"))  # a row for each file
    return records.filter("_record > 0").join(bases, "_file").select((F.col("_record") + F.col("_base")).alias("number"), F.regexp_replace("value", r"\r$", "").alias("record"))


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema, in the order of the file's, and number, of every record (see quoted_records)."""
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return quoted_records(spark, path).select("number", F.from_csv("record", F.lit(schema), options).alias("_r")).select("_r.*", "number")


def read_labelled_csv(spark: SparkSession, path: str, schema: str, source: str, label: str, mapping: dict[str, str]) -> DataFrame:
    """Quoted CSV with headers, with or without a byte order mark; labels are mapped and rows of other labels dropped; id is the source and the padded number of the record."""
    to = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    rows = read_quoted_csv(spark, path, schema).withColumn("label", F.try_element_at(to, F.trim(label))).filter("label is not null")
    return rows.withColumns({"source": F.lit(source), "id": F.format_string("%s-%06d", F.lit(source), F.col("number"))}).drop("number")


def append_once(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows to a log; of rows with a key that is in it already, or of several new ones, readers take one (read_once)."""
    df.write.mode("append").parquet(path)


def read_once(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The rows of a log, of each key the first by `order`."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """A table partitioned by split, so that a reader of one split opens its files only."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the deleted ones."""
    return df.join(gone.select(key).distinct(), key, "left_anti")
