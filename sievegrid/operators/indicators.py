"""Indicators of compromise: normal form, matching with links, hit counts, and indicators derived from links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.urls import HIGH_SIGNAL


def normalized(value: Column, kind: Column) -> Column:
    return F.when(kind == "domain", F.lower(F.trim(value))).otherwise(F.trim(value))


def violations(indicators: DataFrame, key: str = "indicator_id") -> DataFrame:
    """row_key, rule of indicators that are empty, domains with a scheme, path or query, or confidences outside 0 to 1."""
    value, domain = F.trim(F.coalesce("indicator", F.lit(""))), F.col("indicator_type") == "domain"
    rules = F.array_compact(F.array(
        F.when(value == "", "empty"), F.when(domain & value.rlike(r"[:/?#]"), "domain_has_path"), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence_range"),
    ))
    return indicators.select(F.col(key).cast("string").alias("row_key"), F.explode(rules).alias("rule"))


def matched(links: DataFrame, indicators: DataFrame, url: str = "normalized_url", domain: str = "registrable_domain", host: str = "host") -> DataFrame:
    """The links with indicator_id, confidence, match_type and blacklist_hit of the best active indicator.

    The exact link goes before the registrable domain, that before the host; then the smallest id. The indicators are one
    lookup by value, which Spark broadcasts once while it is small; then the links are not shuffled at all.
    """
    best = lambda kind: F.min(F.when(F.col("indicator_type") == kind, F.struct("indicator_id", "confidence")))
    lookup = indicators.filter("status = 'active'").groupBy("indicator").agg(best("url").alias("as_url"), best("domain").alias("as_domain"))
    out = links
    for column, which, name in ((url, "as_url", "_u"), (domain, "as_domain", "_d"), (host, "as_domain", "_h")):
        side = lookup.select(F.col("indicator").alias(f"{name}k"), F.col(which).alias(name))
        out = out.join(side, (F.col(column) == F.col(f"{name}k")) & (F.col(column) != ""), "left").drop(f"{name}k")
    hit = F.coalesce("_u", "_d", "_h")
    kind = F.when(F.col("_u").isNotNull(), "exact_url").when(hit.isNotNull(), "registrable_domain")
    return out.select(*links.columns, hit["indicator_id"].alias("indicator_id"), hit["confidence"].alias("confidence"), kind.alias("match_type"), hit.isNotNull().alias("blacklist_hit"))


def hit_counts(indicators: DataFrame, links: DataFrame, url: str = "normalized_url", stored_domain: str = "stored_domain") -> DataFrame:
    """indicator_id, hits: links whose normal form or stored domain is the indicator, whatever its status; one pass over the links."""
    keys = links.select(F.explode(F.array(F.struct(F.lit("url").alias("kind"), F.col(url).alias("value")), F.struct(F.lit("domain").alias("kind"), F.col(stored_domain).alias("value")))).alias("k")).select("k.*")
    counts = keys.groupBy("kind", "value").agg(F.count("*").alias("_n"))
    joined = indicators.join(counts, (F.col("indicator_type") == F.col("kind")) & (F.col("indicator") == F.col("value")), "left")
    return joined.select("indicator_id", F.coalesce("_n", F.lit(0)).alias("hits"))


def derived(links: DataFrame, known: DataFrame | None = None, tokens: str = "suspicious_tokens", url: str = "normalized_url") -> DataFrame:
    """indicator, confidence of links with a high-signal token: min(0.99, 0.72 + 0.05 for each), unless the link is a known indicator, whatever its status."""
    n = F.size(F.array_intersect(tokens, F.array(*map(F.lit, HIGH_SIGNAL))))
    rows = links.filter((n > 0) & (F.col(url) != "")).groupBy(F.col(url).alias("indicator")).agg(F.round(F.least(F.lit(0.99), 0.72 + 0.05 * F.max(n)), 2).alias("confidence"))
    return rows if known is None else rows.join(known.filter("indicator_type = 'url'").select("indicator").distinct(), "indicator", "left_anti")


def with_derived(indicators: DataFrame, links: DataFrame) -> DataFrame:
    """The indicators and those newly derived from the links, which are active and have no id yet."""
    new = derived(links, indicators).select(F.lit(None).cast("long").alias("indicator_id"), "indicator", F.lit("url").alias("indicator_type"), F.lit("active").alias("status"), "confidence", F.lit("auto_rule").alias("source"))
    return indicators.unionByName(new, allowMissingColumns=True)
