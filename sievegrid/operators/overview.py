"""Counts and reports over stored results, and pages of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def exploded_counts(df: DataFrame, array: Column, name: str) -> DataFrame:
    """Histogram of the elements of an array column."""
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of every listed value, zero where it doesn't occur."""
    names = F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string"))  # the listed values
    found = df.groupBy(key).agg(F.count("*").alias("_n"))
    return names.join(found, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("n"))


def counts_or_unknown(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.trim(F.col(key)), F.lit("")), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))


def daily(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy("day")


def between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows of start <= ts < end; a range that ends before it starts is an error."""
    if end < start:
        raise ValueError("the range ends before it starts")
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def summary(df: DataFrame, split: str, *keys: str) -> DataFrame:
    """Rows of each split in all, and by each of the keys: split, dimension, value, n; from one grouping-sets pass."""
    sets = [[split], *([split, k] for k in keys)]
    cells = df.groupingSets([[F.col(c) for c in s] for s in sets], F.col(split), *(F.col(k) for k in keys)).agg(F.count("*").alias("n"), *(F.grouping(k).alias(f"g_{k}") for k in keys))
    dimension, value = F.lit("records"), F.lit("")
    for k in keys:
        dimension = F.when(F.col(f"g_{k}") == 0, k).otherwise(dimension)
        value = F.when(F.col(f"g_{k}") == 0, F.coalesce(F.col(k).cast("string"), F.lit("<missing>"))).otherwise(value)
    return cells.select(split, dimension.alias("dimension"), value.alias("value"), "n")


def unbalanced(df: DataFrame, partition: str, label: str) -> DataFrame:
    """partition, least, most of partitions whose labels have different numbers of rows; a label that a partition lacks has none."""
    labels = df.select(label).distinct()
    found = df.groupBy(partition, label).agg(F.count("*").alias("n"))
    counts = found.groupBy(partition).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("k")).join(labels.agg(F.count("*").alias("labels")))
    least = F.when(F.col("k") < F.col("labels"), 0).otherwise(F.col("least"))
    return counts.select(partition, least.alias("least"), "most").filter("least <> most")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The rows of one page, numbered from 1."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page numbers start at 1, and a page has 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(df: DataFrame, size: int) -> DataFrame:
    """total and pages of the rows; no rows make no page."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def keyword_search(df: DataFrame, columns: list[str], keyword: str, arrays: tuple[str, ...] = ()) -> DataFrame:
    """Rows in which the keyword occurs in any of the columns, case aside."""
    whole = F.lower(F.concat_ws("\n", *columns, *(F.array_join(a, "\n") for a in arrays)))
    return df.filter(F.contains(whole, F.lit(keyword.lower())))


def matching(df: DataFrame, column: str, keyword: str) -> DataFrame:
    """Rows whose column holds the keyword, case aside; % and _ in it stand for any signs and for one."""
    return df.filter(F.col(column).ilike(f"%{keyword}%"))


def history(detections: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Each detection with the number of its rows in each child table (name → table, foreign key), 0 without any."""
    out = detections
    for name, (table, foreign) in children.items():
        counts = table.groupBy(F.col(foreign).alias("_fk")).agg(F.count("*").alias(name))
        out = out.join(counts, F.col(key) == F.col("_fk"), "left").drop("_fk").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def unseen(df: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose value of none of the keys stands in known."""
    for k in keys:
        df = df.join(known.select(k).distinct(), k, "left_anti")
    return df


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("overlap"))


def upserted(existing: DataFrame, new: DataFrame, key: str, kept_first: str | None = None) -> DataFrame:
    """Keyed merge: a new row replaces the old one; kept_first keeps its old value where there is one."""
    a, b = existing.alias("a"), new.alias("b")
    rows = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    fresh = F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c == kept_first else F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return rows.select(*(pick(c).alias(c) for c in existing.columns)).orderBy(key)
