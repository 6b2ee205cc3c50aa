"""The catalogue of explainable rules, and the score that fuses them with a model's probability.

A message is a row with subject, text_body, sender and reply_to (mailboxes), urls (links with blacklist_hit),
attachments (filename, risk_hints) and parse_warnings; evaluated() adds rule_score and hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions import intents
from sievegrid.functions.text import clipped
from sievegrid.functions.urls import host_of, registrable_domain

# Rule codes with score and severity, weights and bands; the wording of evidence below is fixed too.
CATALOGUE = {
    "R01": (15.0, "warning"), "R02": (20.0, "critical"), "R03": (40.0, "critical"), "R04": (10.0, "warning"), "R05": (15.0, "warning"),
    "R06": (10.0, "warning"), "R07": (20.0, "critical"), "R08": (5.0, "info"), "R09": (10.0, "warning"), "R10": (10.0, "warning"),
}
MOST_SCORE = 100.0
MODEL_WEIGHT, RULE_WEIGHT = 0.65, 0.35
LOW_BELOW, HIGH_FROM, LABEL_FROM = 30.0, 60.0, 0.5
ADVICE = {
    "low": ("No strong phishing signal was found.", "Check the sender if you did not expect this message."),
    "medium": ("Verify the sender through another channel before acting.", "Do not open links or attachments until verified."),
    "high": ("Do not open links or attachments and do not reply.", "Report the message to your security team."),
}


def _first(items: Column, condition, value) -> Column:
    return F.get(F.transform(F.filter(items, condition), value), F.lit(0))


def display_domain(display: Column) -> Column:
    """The registrable domain that a link's text shows, or empty."""
    return registrable_domain(host_of(display))


def target_domain(link: Column) -> Column:
    return F.when(link["registrable_domain"] != "", link["registrable_domain"]).otherwise(link["host"])


def evidence(urgent: list[str] | None = None, sensitive: list[str] | None = None, brands: list[str] | None = None) -> dict[str, Column]:
    """For each rule the evidence of its hit, null where it doesn't hit. urls carry display_domain where display_text is set."""
    text = F.lower(F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("text_body", F.lit(""))))
    urgent, sensitive, brands = urgent or intents.URGENT, sensitive or intents.SENSITIVE, brands or intents.BRANDS
    sender, other, urls = F.coalesce(F.col("sender.domain"), F.lit("")), F.coalesce(F.col("reply_to.domain"), F.lit("")), F.col("urls")
    differs = lambda u: (F.trim(u["display_text"]) != "") & (u["display_domain"] != "") & (target_domain(u) != "") & (u["display_domain"] != target_domain(u))
    warnings = F.filter("parse_warnings", lambda w: w.rlike("^(missing_|invalid_|decode_)"))
    named = F.filter(intents.listed(brands), lambda b: F.contains(text, b) & (sender != "") & ~F.contains(sender, F.replace(b, F.lit(" "), F.lit(""))))
    sender_ok = F.coalesce(F.col("sender.is_valid"), F.lit(False)) & (F.coalesce(F.col("sender.address"), F.lit("")) != "")
    return {
        "R01": F.when((sender != "") & (other != "") & (sender != other), F.concat(F.lit("from="), sender, F.lit("; reply_to="), other)),
        "R02": _first(urls, differs, lambda u: F.concat(F.lit("display="), u["display_domain"], F.lit("; target="), target_domain(u))),
        "R03": _first(urls, lambda u: F.coalesce(u["blacklist_hit"], F.lit(False)), lambda u: F.when(u["normalized_url"] != "", u["normalized_url"]).otherwise(u["raw_url"])),
        "R04": F.when(intents.contains_any(text, urgent), intents.first_match(text, urgent)),
        "R05": F.when(intents.contains_any(text, sensitive), intents.first_match(text, sensitive)),
        "R06": _first(urls, lambda u: F.size(u["suspicious_tokens"]) > 0, lambda u: F.concat(F.when(u["host"] != "", u["host"]).otherwise(u["raw_url"]), F.lit(": "), F.array_join(F.slice(u["suspicious_tokens"], 1, 5), ", "))),
        "R07": _first(F.col("attachments"), lambda a: F.size(a["risk_hints"]) > 0, lambda a: F.concat(a["filename"], F.lit(": "), F.array_join(a["risk_hints"], ", "))),
        "R08": F.when(~sender_ok, F.when(F.coalesce(F.col("sender.address"), F.lit("")) != "", F.col("sender.address")).otherwise("missing_from")),
        "R09": F.when(F.size(warnings) > 0, F.array_join(F.slice(warnings, 1, 4), ", ")),
        "R10": F.when(F.size(named) > 0, F.concat(F.lit("brand="), F.get(named, F.lit(0)), F.lit("; sender_domain="), sender)),
    }


def evaluated(messages: DataFrame, **lists) -> DataFrame:
    """The messages with hits (code, evidence, score, severity; in the order of the catalogue) and rule_score, at most 100."""
    found = evidence(**lists)
    hits = F.array_compact(
        F.array(*(F.when(found[c].isNotNull(), F.struct(F.lit(c).alias("code"), clipped(found[c]).alias("evidence"), F.lit(score).alias("score"), F.lit(severity).alias("severity"))) for c, (score, severity) in CATALOGUE.items()))
    )
    out = messages.withColumn("hits", hits)
    return out.withColumn("rule_score", F.least(F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["score"]), F.lit(MOST_SCORE)))


def analysed(messages: DataFrame, probability: Column, **lists) -> DataFrame:
    """evaluated() with model_probability, final_score, risk_level, result_label and advice."""
    out = evaluated(messages, **lists).withColumn("model_probability", probability)
    out = out.withColumn("final_score", fused(F.col("model_probability"), F.col("rule_score"))).withColumn("risk_level", risk_level(F.col("final_score")))
    return out.withColumns({"result_label": result_label(F.col("model_probability")), "advice": advice(F.col("risk_level"))})


def fused(probability: Column, rule_score: Column) -> Column:
    """100 (0.65 p + 0.35 r / 100), both clamped, half-even to one decimal; null for values that aren't finite.

    Tenths are rounded, not the digits of the sum: they even out its last bit, so 59.650000000000006, which 0.6 and 59 give, is the tie it stands for.
    """
    p, r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability)), F.greatest(F.lit(0.0), F.least(F.lit(100.0), rule_score)) / 100
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite(probability) & finite(rule_score), F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (MODEL_WEIGHT * p + RULE_WEIGHT * r) * 100)) * 10) / 10)


def risk_level(score: Column) -> Column:
    return F.when(score < LOW_BELOW, "low").when(score < HIGH_FROM, "medium").otherwise("high")


def result_label(probability: Column) -> Column:
    return F.when(probability >= LABEL_FROM, "phishing").otherwise("legitimate")


def advice(risk: Column) -> Column:
    return F.element_at(F.create_map(*(x for k, v in ADVICE.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), risk)
