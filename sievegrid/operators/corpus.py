"""Corpus jobs: representatives, deduplication with label conflicts, near-duplicate audit, splits and samples.

Order-based choices use hash order, which no partitioning changes.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.operators.ranks import hash_bucket, hash_order, numbered, with_value_bucket
from sievegrid.sources.files import written


def representative(df: DataFrame, key: str, warnings: str = "parse_warnings", chars: str = "original_chars", row_id: str = "id") -> DataFrame:
    """Of each key the row with the fewest warnings, then the longest, then the smallest id; whole rows, found again by key and id."""
    best = _narrow(df, key, warnings, chars, row_id).groupBy("_key").agg(F.min(F.struct("w", "c", "id")).alias("best")).select("_key", F.col("best.id").alias("_id"))
    return df.join(best, (F.col(key) == F.col("_key")) & (F.col(row_id) == F.col("_id")), "left_semi")


def _narrow(df: DataFrame, key: str, warnings: str, chars: str, row_id: str, *more: Column) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.size(warnings).alias("w"), (-F.col(chars)).alias("c"), F.col(row_id).alias("id"), *more)


def _groups(df: DataFrame, raw: str, content: str, label: str, warnings: str, chars: str, row_id: str) -> DataFrame:
    """content, id of the representative, members, mixed, and what stage one found: rows, groups of more than one row. Texts stay out of both shuffles."""
    rows = _narrow(df, raw, warnings, chars, row_id, F.col(content).alias("content"), F.coalesce(label, F.lit("")).alias("label"))
    first = rows.groupBy("_key").agg(F.min(F.struct("w", "c", "id", "content", "label")).alias("f"), F.count("*").alias("n"))
    return first.groupBy(F.col("f.content").alias("content")).agg(
        F.min(F.struct("f.w", "f.c", "f.id")).alias("best"), F.count("*").alias("members"), (F.min("f.label") != F.max("f.label")).alias("mixed"),
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"),
    )


def deduplicated_ids(df: DataFrame, raw: str = "source_hash", content: str = "content_fingerprint", label: str = "label", warnings: str = "parse_warnings", chars: str = "original_chars", row_id: str = "id") -> DataFrame:
    """id, dedup_group: one row of each raw hash, then of each content fingerprint; groups that mix labels go whole. dedup_group is the fingerprint."""
    return _groups(df, raw, content, label, warnings, chars, row_id).filter("not mixed").select(F.col("best.id").alias(row_id), F.col("content").alias("dedup_group"))


def deduplicated(df: DataFrame, row_id: str = "id", **columns: str) -> DataFrame:
    """The rows of deduplicated_ids(), whole, with dedup_group."""
    return df.join(deduplicated_ids(df, row_id=row_id, **columns), row_id)


def dedup_report(df: DataFrame, raw: str = "source_hash", content: str = "content_fingerprint", label: str = "label", warnings: str = "parse_warnings", chars: str = "original_chars", row_id: str = "id") -> DataFrame:
    """One row of counts: input, retained, and what each stage removes."""
    groups = _groups(df, raw, content, label, warnings, chars, row_id)
    add = lambda value, c=None: F.coalesce(F.sum(value if c is None else F.when(c, value)), F.lit(0))
    whole, mixed = ~F.col("mixed"), F.col("mixed")
    return groups.agg(
        add(F.col("rows")).alias("input_records"), add(F.col("repeated")).alias("raw_hash_duplicate_groups"), add(F.col("rows") - F.col("members")).alias("raw_hash_removed"),
        F.count_if(whole).alias("retained_records"), F.count_if(whole & (F.col("members") > 1)).alias("content_duplicate_groups"), add(F.col("members") - 1, whole).alias("content_duplicate_removed"),
        F.count_if(mixed).alias("label_conflict_groups_dropped"), add(F.col("members"), mixed).alias("label_conflict_records_dropped"),
    )


def simhash_classes(df: DataFrame, key: str, simhash: str) -> DataFrame:
    """hash (a long), class_key (the smallest key), members: rows of equal 64-bit hash (16 hex digits); rows of equal key are one."""
    half = lambda k: F.conv(F.substring(simhash, 8 * k + 1, 8), 16, 10).cast("long")
    rows = df.select(F.col(key).alias("key"), F.shiftleft(half(0), 32).bitwiseOR(half(1)).alias("hash")).distinct()
    return rows.groupBy("hash").agg(F.min("key").alias("class_key"), F.count("*").alias("members"))


def near_duplicate_pairs(classes: DataFrame, radius: int = 3, pieces: int = 6) -> DataFrame:
    """left_key < right_key, left_members, right_members of classes whose hashes differ in at most `radius` bits; rows of a class are all alike.

    Hashes within the radius agree in all but `radius` of the pieces, so they meet in a table of the other pieces: of 32 bits
    each, not of 16, which hot values would fill. A pair is taken from the first table in which it meets.
    """
    edges = [round(64 * k / pieces) for k in range(pieces + 1)]
    masks = []
    for chosen in itertools.combinations(range(pieces), pieces - radius):
        mask = sum(1 << b for p in chosen for b in range(edges[p], edges[p + 1]))
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    tables = F.posexplode(F.array(*(F.col("hash").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "value")
    posted = classes.select("hash", "class_key", "members", tables)
    a, b = posted.alias("a"), posted.alias("b")
    both = F.col("a.hash").bitwiseXOR(F.col("b.hash"))
    first = F.array_position(F.array(*(both.bitwiseAND(F.lit(m)) == 0 for m in masks)), True) - 1
    near = (F.col("a.t") == F.col("b.t")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.class_key") < F.col("b.class_key")) & (F.bit_count(both) <= radius)
    pairs = a.join(b, near).filter(F.col("a.t") == first)
    return pairs.select(F.col("a.class_key").alias("left_key"), F.col("b.class_key").alias("right_key"), F.col("a.members").alias("left_members"), F.col("b.members").alias("right_members"))


def near_duplicate_counts(classes: DataFrame) -> DataFrame:
    """One row: near_duplicate_pairs between rows, within classes and across them, and near_duplicate_records that stand in some pair."""
    n = F.col("members")
    inside = classes.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long").alias("inside"))
    classes = written(classes, "classes")
    pairs = written(near_duplicate_pairs(classes), "pairs")
    across = pairs.agg(F.coalesce(F.sum(F.col("left_members") * F.col("right_members")), F.lit(0)).alias("across"))
    met = pairs.select(F.explode(F.array("left_key", "right_key")).alias("class_key")).union(classes.filter("members > 1").select("class_key")).distinct()
    records = classes.join(met, "class_key").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("near_duplicate_records"))
    return inside.join(across).join(records).select((F.col("inside") + F.col("across")).alias("near_duplicate_pairs"), "near_duplicate_records")


def holdout(df: DataFrame, strata: list[str], row_id: str, share: float = 0.1, least: int = 10) -> DataFrame:
    """Column held: of each stratum with at least `least` rows the first max(1, floor(n · share)) in hash order."""
    rows = numbered(df, strata, hash_order(row_id), hash_bucket(row_id), "_at", "_all")
    held = (F.col("_all") >= least) & (F.col("_at") <= F.greatest(F.lit(1), F.floor(F.col("_all") * share)))
    return rows.withColumn("held", held).drop("_at", "_all")


def group_split(df: DataFrame, group: str, label: str, shares: tuple[float, float] = (0.70, 0.85), strict: bool = False) -> DataFrame:
    """Column split: train, valid or test by label, in hash order of groups; a group is never divided. strict: a group of several labels is an error."""
    groups = df.groupBy(group).agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
    if strict and not groups.filter("_label <> _other").isEmpty():
        raise ValueError("a group has rows of several labels")
    rows = numbered(groups.select(group, "_label"), ["_label"], hash_order(group), hash_bucket(group), "_at", "_all")
    at = (F.col("_at") - 0.5) / F.col("_all")
    rows = rows.withColumn("split", F.when(at < shares[0], "train").when(at < shares[1], "valid").otherwise("test")).select(F.col(group).alias("_group"), "split")
    return df.join(rows, F.col(group) == F.col("_group")).drop("_group")


def balanced_cap(df: DataFrame, label: str, row_id: str, limit: int, least: int = 0) -> DataFrame:
    """The same number of rows of every label, limit / labels each at most, in hash order. least: with fewer rows of a label, an error.

    Each task passes on only the first rows of a label, so the shuffle holds limit rows from a task at most.
    """
    counts = [r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()]  # a row for each label
    if least and min(counts, default=0) < least:
        raise ValueError("a label has too few rows")
    place = F.row_number().over(Window.partitionBy(label).orderBy(*hash_order(row_id)))
    return df.withColumn("_place", place).filter(F.col("_place") <= limit // max(1, len(counts))).drop("_place")


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def sequence_ids(df: DataFrame, source: str, order: str) -> DataFrame:
    """Column seq_id: source and a zero-padded number in order within the source."""
    rows = numbered(with_value_bucket(df, order, "_value"), [source], [F.col(order)], F.col("_value"), "_at")
    return rows.withColumn("seq_id", F.format_string("%s-%06d", F.col(source), F.col("_at") - 1)).drop("_value", "_at")


def review_queue(df: DataFrame, label: str, intents: str, row_id: str, limit: int, ambiguous: tuple[str, ...] | list[str] = ("social_pressure", "reply_or_data_request")) -> DataFrame:
    """Two thirds rows without an intent and one third rows of one ambiguous intent, both legitimate, numbered."""
    ok = F.col(label) == "legitimate"
    plain = df.filter(ok & (F.size(intents) == 0)).orderBy(*hash_order(row_id)).limit(max(1, limit * 2 // 3)).withColumn("_part", F.lit(0))
    vague = F.array_join(intents, ",").isin(list(ambiguous))
    unsure = df.filter(ok & vague).orderBy(*hash_order(row_id)).limit(max(1, limit // 3)).withColumn("_part", F.lit(1))
    chosen = plain.unionByName(unsure)
    number = F.row_number().over(Window.orderBy("_part", *hash_order(row_id))) - 1  # at most `limit` rows
    return chosen.withColumn("review_id", F.format_string("intent-review-%04d", number)).drop("_part")


def mixed_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return df.groupBy(group).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split")).filter("first_split <> last_split")


def folds(df: DataFrame, label: str, row_id: str, k: int) -> DataFrame:
    """Column fold: 0 to k - 1, stratified by label, in hash order."""
    return numbered(df, [label], hash_order(row_id), hash_bucket(row_id), "_at").withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at")
