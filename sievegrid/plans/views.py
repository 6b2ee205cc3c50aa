"""The message, link, indicator and score views of the driver's tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import text, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents (those of the table, or others) as messages: the first line is the subject; toxic ones are phishing, poor ones other spam."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_l"))
    label = F.when(F.col("toxic") == 1, "phishing").when(F.col("quality") == 0, "spam_other").when(F.col("_l"), "legitimate")
    subject = F.substring(F.substring_index("text", "\n", 1), 1, 240)
    rows = (table(spark, sf_dir, "documents") if docs is None else docs).join(labels, "doc_id", "left")
    return rows.select("doc_id", "source", "lang", subject.alias("subject"), F.col("text").alias("text_body"), F.sha2("text", 256).alias("source_hash"), label.alias("label"))


MESSAGES = """messages AS (
  SELECT d.doc_id, d.source, d.lang, substr(split_part(d.text, chr(10), 1), 1, 240) AS subject, d.text AS text_body, sha256(d.text) AS source_hash,
    CASE WHEN l.toxic = 1 THEN 'phishing' WHEN l.quality = 0 THEN 'spam_other' WHEN l.doc_id IS NOT NULL THEN 'legitimate' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the cleaned text and its fingerprint, and a label by the parity of the source, so that copies conflict."""
    m = text.with_model_text(messages(spark, sf_dir))
    columns = ["source", "lang", "source_hash", "label", "subject", "text_body", "model_text", "parse_warnings", "original_chars"]
    return m.select(F.col("doc_id").alias("id"), *columns, text.fingerprint("model_text").alias("content_fingerprint"))


def sql_normalized(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '[ \\t\\f\\x0b]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({t}, ' ' || chr(10))"


SQL_EMAIL = r"[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]*[A-Za-z0-9]"
SQL_URL = r"(?i:https?://|ftp://|www\.)[^\s<>\"]+"
SQL_NUMBER = r"\b\d{5,}\b"


def sql_masked(x: str) -> str:
    t = f"regexp_replace({sql_normalized(x)}, '{SQL_EMAIL}', '<EMAIL>', 'g')"
    return f"regexp_replace(regexp_replace({t}, '{SQL_URL}', '<URL>', 'g'), '{SQL_NUMBER}', '<NUMBER>', 'g')"


CLEANED = f"""{MESSAGES}, fields AS (
  SELECT *, {sql_masked("subject")} AS s, {sql_masked("text_body")} AS b FROM messages),
cleaned AS (
  SELECT doc_id AS id, source, lang, source_hash, label, subject, text_body, substr(s || chr(10) || b, 1, 20000) AS model_text,
    sha256(substr(s || chr(10) || b, 1, 20000)) AS content_fingerprint, length(coalesce(subject, '')) + length(coalesce(text_body, '')) AS original_chars,
    list_filter([CASE WHEN s = '' THEN 'empty_subject' END, CASE WHEN b = '' THEN 'empty_text_body' END,
      CASE WHEN length(s) + length(b) + 1 > 20000 THEN 'model_text_truncated' END], lambda x: x IS NOT NULL) AS parse_warnings
  FROM fields)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own links, taken apart; stored_domain is the registrable domain or else the host."""
    u = urls.with_parsed(table(spark, sf_dir, "pages").select("page_id", "url"), "url").drop("url")
    return u.withColumn("stored_domain", F.when(F.col("registrable_domain") != "", F.col("registrable_domain")).otherwise(F.col("host")))


#: All links of the table are absolute ones without port, user or address hosts; the SQL reads just those.
LINKS = r"""links AS (
  SELECT page_id, url AS raw_url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
linked AS (
  SELECT *, scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS normalized_url,
    array_to_string(list_slice(string_split(host, '.'), CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN
      ('ac.cn', 'ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.cn', 'com.hk', 'com.sg', 'edu.cn', 'gov.cn', 'net.cn', 'org.cn') AND len(string_split(host, '.')) >= 3 THEN -3 ELSE -2 END, -1), '.') AS registrable_domain
  FROM links)"""


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some links, domains and hosts of the pages as indicators, two thirds of them active."""
    u = links(spark, sf_dir)
    value = F.when(F.col("page_id") % 5 == 0, F.col("normalized_url")).when(F.col("page_id") % 5 == 1, F.col("host"))
    value = F.when(F.col("page_id") % 50 == 2, F.col("registrable_domain")).otherwise(value)
    rows = u.withColumn("indicator", value).filter("indicator is not null").withColumn("indicator_type", F.when(F.col("page_id") % 5 == 0, "url").otherwise("domain"))
    status = F.when(F.col("page_id") % 3 == 0, "review").otherwise("active")
    return rows.select(F.col("page_id").alias("indicator_id"), "indicator", "indicator_type", status.alias("status"), (F.col("page_id") % 100 / 100).alias("confidence"))


INDICATORS = f"""{LINKS}, named AS (
  SELECT *, CASE WHEN page_id % 50 = 2 THEN registrable_domain WHEN page_id % 5 = 0 THEN normalized_url WHEN page_id % 5 = 1 THEN host END AS indicator FROM linked),
indicators AS (
  SELECT page_id AS indicator_id, indicator, CASE WHEN page_id % 5 = 0 THEN 'url' ELSE 'domain' END AS indicator_type,
    CASE WHEN page_id % 3 = 0 THEN 'review' ELSE 'active' END AS status, (page_id % 100) / 100 AS confidence FROM named WHERE indicator IS NOT NULL)"""


def _digest(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 4), 16, 10).cast("double") / 65535


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: probability and a baseline by hash, the label by event type."""
    key = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", "event_type", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"), "value",
        F.when(F.col("event_type").isin("error", "purchase"), "phishing").otherwise("legitimate").alias("label"),
        _digest(key).alias("probability"), _digest(F.concat(key, F.lit("b"))).alias("baseline"), (F.col("event_id") % 101).cast("double").alias("rule_score"),
    )


SCORED = """scored AS (
  SELECT event_id AS id, ts, event_type, 's' || (user_id % 5)::VARCHAR AS source, value, CASE WHEN event_type IN ('error', 'purchase') THEN 'phishing' ELSE 'legitimate' END AS label,
    ('0x' || substr(md5(event_id::VARCHAR), 1, 4))::INTEGER::DOUBLE / 65535 AS probability, ('0x' || substr(md5(event_id::VARCHAR || 'b'), 1, 4))::INTEGER::DOUBLE / 65535 AS baseline,
    (event_id % 101)::DOUBLE AS rule_score FROM events)"""
