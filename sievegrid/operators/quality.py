"""Data-quality checks: reason-coded drops, violation rows, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """row_key, rule for each rule whose condition a row breaks; a condition that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("rule"))


def reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Column reason: the first check, in order, that a row fails, or null."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(checks.items()):
        out = F.when(F.coalesce(failed, F.lit(True)), name).otherwise(out)
    return df.withColumn("reason", out)


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, label: str, content: str) -> DataFrame:
    """Histogram of the label with `<missing>`, beside the columns and a hash of the content that no order of rows changes."""
    part = F.conv(F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 8), 16, 10).cast("long")
    rows = df.groupBy(F.coalesce(F.nullif(F.trim(F.col(label).cast("string")), F.lit("")), F.lit("<missing>")).alias("label")).agg(F.count("*").alias("n"), F.sum(part).alias("content_hash"))
    return rows.withColumns({"fields": F.lit(len(df.columns)), "field_names": F.lit(",".join(df.columns))})


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """row_key, rule: keys that are empty, and keys that stand on several rows, once each."""
    counts = df.groupBy(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("row_key")).agg(F.count("*").alias("n"))
    return counts.select("row_key", F.when(F.col("row_key") == "", "empty_key").when(F.col("n") > 1, "duplicate_key").alias("rule")).filter("rule is not null")


LABELS, SPLITS = ["legitimate", "phishing"], ["train", "valid", "test"]


def training_violations(rows: DataFrame, hard: DataFrame, supplement: DataFrame) -> DataFrame:
    """part, row_key, rule of what may not enter a training run; a missing column of rows is an error.

    rows: id, source, label, subject, text_body, model_text, split, content_fingerprint; hard and supplement: id, label and, for
    supplement, dataset_partition and content_fingerprint.
    """
    if missing := {"id", "source", "label", "subject", "text_body", "model_text", "split"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    base = violations(rows, "id", {"label": F.col("label").isin(LABELS), "split": F.col("split").isin(SPLITS), "model_text": F.trim("model_text") != ""})
    pure = violations(hard, "id", {"hard_negative": F.col("label") == "spam_other"})
    known = rows.filter("split = 'train' and content_fingerprint <> ''").select("content_fingerprint", F.lit(True).alias("_known")).distinct()
    more = supplement.join(known, "content_fingerprint", "left")
    checks = {"label": F.col("label").isin(LABELS), "partition": F.coalesce("dataset_partition", F.lit("train")) == "train", "overlap": F.col("_known").isNull()}
    parts = {"rows": base, "hard": pure, "supplement": violations(more, "id", checks)}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("part"), "row_key", "rule")
        out = part if out is None else out.union(part)
    return out


def result_rules() -> dict[str, Column]:
    """Conditions of a stored result: ranges, the fused score, band and label."""
    from sievegrid.functions.rules import fused, result_label, risk_level

    return {
        "probability_range": F.col("probability").between(0, 1),
        "rule_range": F.col("rule_score").between(0, 100),
        "fused_score": F.abs(F.col("final_score") - fused(F.col("probability"), F.col("rule_score"))) <= 0.05,
        "risk_level": F.col("risk_level") == risk_level(F.col("final_score")),
        "label": F.col("result_label") == result_label(F.col("probability")),
    }


def roles(path: Column, table: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(data origin, allowed role) of the first pattern that the path contains, or unknown."""
    origin = role = F.lit("unknown")
    for pattern, o, r in reversed(table):
        origin, role = F.when(path.contains(pattern), o).otherwise(origin), F.when(path.contains(pattern), r).otherwise(role)
    return origin, role


def _row_check(column: str, check: str, arguments: str) -> Column | None:
    """The condition that a row must meet, or None for checks of another kind."""
    c, items = F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit(""), arguments.split(",")
    if check == "absolute_url":
        return c.rlike(r"^https?://[^/?#]")
    if check == "one_of":
        return c.isin(items)
    if check == "matches":
        return c.rlike(arguments)
    if check == "safe_path":  # below the folder, and without a step up
        return ((c == arguments) | c.startswith(f"{arguments}/")) & ~F.array_contains(F.split(c, "/"), "..")
    if check == "present_if":
        other, values = arguments.split("=", 1)
        return ~F.coalesce(F.col(other).isin(values.split(",")), F.lit(False)) | (F.trim(c) != "")
    return None


def unmet(df: DataFrame, expectations: DataFrame, key: str) -> DataFrame:
    """row_key, rule of what a table of expectations (column, check, arguments; at most a few hundred rows) finds wrong.

    Checks of a row, all in one pass: absolute_url; one_of (values); matches (a pattern); safe_path (the folder that it must stay in); present_if (other=values).
    Of a column: key (not empty, a row each), covers (just these values, of which row_key names those that are missing or too many). Of the table: columns (just
    these; rules missing_column and extra_column). An unknown check, or one on a column that isn't there, is an error.
    """
    asked = [(r["column"] or "", r["check"], r["arguments"] or "") for r in expectations.select("column", "check", "arguments").collect()]
    rows = {f"{c}:{k}": condition for c, k, a in asked if (condition := _row_check(c, k, a)) is not None}
    parts = [violations(df, key, rows).withColumn("row_key", F.trim("row_key"))] if rows else []
    for column, check, arguments in asked:
        if check == "key":
            parts.append(key_violations(df, column).withColumn("rule", F.concat(F.lit(f"{column}:"), F.col("rule"))))
        elif check == "covers":
            wanted = df.sparkSession.createDataFrame([(v,) for v in arguments.split(",")], "row_key string")
            found = df.select(F.col(column).cast("string").alias("row_key")).distinct()
            parts.append(wanted.join(found, "row_key", "left_anti").union(found.join(wanted, "row_key", "left_anti")).withColumn("rule", F.lit(f"{column}:covers")))
        elif check == "columns":
            wanted = set(arguments.split(","))
            odd = [(c, "missing_column") for c in sorted(wanted - set(df.columns))] + [(c, "extra_column") for c in sorted(set(df.columns) - wanted)]
            parts.append(df.sparkSession.createDataFrame(odd, "row_key string, rule string"))
        elif f"{column}:{check}" not in rows:
            raise ValueError(f"unknown check: {check}")
    return reduce(lambda a, b: a.unionByName(b.select("row_key", "rule")), parts).select("row_key", "rule") if parts else df.sparkSession.createDataFrame([], "row_key string, rule string")
