"""The registered queries of message scoring and of models over several views: features, stored analyses, streams, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegrid.functions import features, intents, message, rules, text
from sievegrid.operators import multiview, overview, quality
from sievegrid.plans import views
from sievegrid.plans.analytics import ODD_LINKS, _odd_links
from sievegrid.plans.queries import BRAND_WORDS, ENDINGS, INTENT_WORDS, RULE_SCORES, RULED, SENSITIVE_WORDS, URGENT_WORDS, UPSERT_SQL, _list, _manifests, _ruled, _tagged, query
from sievegrid.plans.views import MESSAGES, messages, table
from sievegrid.sources import files, store
from sievegrid.sources.keyed import KeyedTable
from sievegrid.streaming import jobs
from sievegrid.streaming.jobs import score_stream

LISTS = {"urgent": URGENT_WORDS, "sensitive": SENSITIVE_WORDS, "brands": BRAND_WORDS}


def _with_page(spark, d, docs=None):
    """The messages of _ruled() with the page of their link as html_body, and with people, headers and the text that character models read."""
    pages = table(spark, d, "pages").count()
    page = table(spark, d, "pages").select(F.col("page_id").alias("_p"), F.when(F.col("page_id") % 4 != 0, F.col("html")).otherwise("").alias("html_body"))
    box = lambda c: F.array(message.mailbox(F.concat(F.lit(c), F.lit("@mail.example"))))
    rows = _ruled(spark, d, docs).withColumn("_p", F.col("doc_id") % pages).join(page, "_p").drop("_p")
    k = F.col("doc_id")
    return rows.withColumns(
        {
            "char_text": text.char_text("subject", "text_body"), "return_path": message.mailbox(F.when(k % 2 == 0, "r@bounce.example").otherwise("")), "recipients": box("to"),
            "cc": F.when(k % 3 == 1, box("cc")).otherwise(F.array_repeat(message.mailbox(F.lit("")), 0)), "headers": F.create_map(F.lit("to"), F.lit("x"), F.lit("lang"), F.col("subject")),
        }
    )


STRUCTURE_SQL = f"""{RULED}, m AS (SELECT r.doc_id, d.text, r.sender, r.reply, r.scheme, r.host, r.registrable_domain AS domain, r.query, r.tokens, r.display_domain AS shown, CASE WHEN r.page_id % 4 <> 0 THEN p.html ELSE '' END AS html, substr(split_part(d.text, chr(10), 1), 1, 240) AS subject
    FROM ruled r JOIN documents d ON d.doc_id = r.doc_id JOIN pages p ON p.page_id = r.page_id),
  n AS (SELECT *, substr(regexp_replace(regexp_replace(subject || chr(10) || text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), 1, 20000) AS t FROM m)"""
_COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
STRUCTURE_VALUES = {
    "subject_chars": "length(subject)", "body_chars": "length(text)", "word_count": _COUNT("t", "[\\p{L}\\p{N}_\\p{M}]+"), "line_count": "length(t) - length(replace(t, chr(10), '')) + 1",
    "non_ascii_ratio": f"{_COUNT('t', '[^\\x00-\\x7F]')} / length(t)", "uppercase_ratio": f"coalesce({_COUNT('t', '\\p{Lu}')} / nullif({_COUNT('t', '\\p{L}')}, 0), 0)", "digit_ratio": f"{_COUNT('t', '\\p{Nd}')} / length(t)",
    "exclamation_count": "length(t) - length(translate(t, '!！', ''))", "question_count": "length(t) - length(translate(t, '?？', ''))", "email_address_count": _COUNT("t", "(?i)[A-Z0-9._%+\\-]+@(?:[A-Z0-9-]+\\.)+[A-Z]{2,}"),
    "url_count": "1", "distinct_domain_count": "1", "https_url_ratio": "(scheme = 'https')::INTEGER", "ip_url_count": "0", "shortener_url_count": "0", "punycode_url_count": "contains(host, 'xn--')::INTEGER", "suspicious_url_token_count": "len(tokens)",
    "nested_url_count": "regexp_matches(lower(query), 'http%3a|https%3a|url=http|redirect=http|target=http')::INTEGER", "display_link_mismatch_count": "(shown <> '' AND shown <> domain)::INTEGER", "sender_present": "(sender <> '')::INTEGER",
    "reply_to_present": "(reply <> '')::INTEGER", "sender_reply_domain_mismatch": "(sender <> '' AND reply <> '' AND sender <> reply)::INTEGER", "return_path_domain_mismatch": "(sender <> '' AND doc_id % 2 = 0)::INTEGER",
    "recipient_count": "1 + (doc_id % 3 = 1)::INTEGER", "header_count": "2", "parse_warning_count": "(doc_id % 11 = 0)::INTEGER + (doc_id % 7 = 0)::INTEGER", "attachment_count": "1", "risky_attachment_count": "(doc_id % 5 <> 3)::INTEGER", "html_present": "(html <> '')::INTEGER",
    "html_tag_count": _COUNT("html", "<\\s*[a-zA-Z][^>]*>"), "html_link_count": _COUNT("html", "(?i)<\\s*a\\b"), "html_image_count": _COUNT("html", "(?i)<\\s*img\\b"), "text_to_html_ratio": "coalesce(length(text) / nullif(length(html), 0), 0)",
}


@query(f"WITH {STRUCTURE_SQL} SELECT doc_id, {', '.join(f'round(({v})::DOUBLE, 9) AS {k}' for k, v in STRUCTURE_VALUES.items())} FROM n")
def b23_structure_features(spark, d):
    rows = features.with_structure(_with_page(spark, d))
    return rows.select("doc_id", *(F.round(c, 9).alias(c) for c in features.STRUCTURE))


@query(f"""WITH {RULED} SELECT r.doc_id, CASE WHEN r.doc_id % 5 = 1 THEN NULL ELSE CASE WHEN sender = '' THEN '' ELSE 'a@' || sender END END AS sender, CASE WHEN r.doc_id % 5 = 1 THEN NULL ELSE 1 END AS links, CASE WHEN r.doc_id % 5 <> 1 THEN raw_url END AS raw_url,
  CASE WHEN r.doc_id % 5 <> 1 THEN len(tokens) END AS tokens, CASE WHEN r.doc_id % 5 <> 1 THEN 'file.' || {[*ENDINGS]}[(r.doc_id % 5)::INTEGER + 1] END AS filename, CASE WHEN r.doc_id % 5 <> 1 THEN length(split_part(d.text, chr(10), 1)[:240]) END AS subject_chars FROM ruled r JOIN documents d ON d.doc_id = r.doc_id""")
def b31_rebuild_context(spark, d):
    """Messages to JSON, with items that can't be read and contexts that are none, and back."""
    k = F.col("doc_id")
    rows = _ruled(spark, d).withColumn("whole", F.to_json(F.struct("subject", "sender", "reply_to", "urls", "attachments", "parse_warnings")))
    bad = F.regexp_replace("whole", r'"urls":\[', '"urls":[7,{"host":"no.raw.example"},')
    bad = F.regexp_replace(bad, r'"attachments":\[', '"attachments":["x",{"filename":""},')
    rows = rows.select("doc_id", F.when(k % 5 == 1, "[1]").when(k % 5 == 2, "not json").otherwise(F.when(k % 2 == 0, bad).otherwise(F.col("whole"))).alias("a"), F.when(k % 5 == 2, F.col("whole")).alias("b"))
    c = features.with_context(rows, "a", "b")
    first = F.col("context.urls")[0]
    return c.select(
        "doc_id", F.col("context.sender.address").alias("sender"), F.when(F.col("context").isNotNull(), F.size("context.urls")).alias("links"), first["raw_url"].alias("raw_url"), F.when(F.col("context").isNotNull(), F.size(first["suspicious_tokens"])).alias("tokens"),
        F.col("context.attachments")[0]["filename"].alias("filename"), F.length("context.subject").alias("subject_chars"),
    )


TRAINING_SQL = f"""{MESSAGES}, base AS (SELECT doc_id, CASE WHEN label IS NULL AND doc_id % 2 = 0 THEN 'legitimate' ELSE label END AS label, CASE WHEN doc_id % 19 = 0 THEN '  ' ELSE text_body END AS model_text, CASE WHEN doc_id % 23 = 0 THEN 'dev' WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, source_hash FROM messages),
  v AS (SELECT 'rows' AS part, doc_id, [CASE WHEN coalesce(label NOT IN ('legitimate', 'phishing'), true) THEN 'label' END, CASE WHEN split = 'dev' THEN 'split' END, CASE WHEN trim(model_text) = '' THEN 'model_text' END] AS r FROM base
    UNION ALL SELECT 'hard', doc_id, [CASE WHEN coalesce(label <> 'spam_other', true) THEN 'hard_negative' END] FROM messages WHERE doc_id % 5 = 0
    UNION ALL SELECT 'supplement', doc_id + 1, [CASE WHEN coalesce(label NOT IN ('legitimate', 'phishing'), true) THEN 'label' END, CASE WHEN doc_id % 8 = 0 THEN 'partition' END, CASE WHEN source_hash IN (SELECT source_hash FROM base WHERE split = 'train') THEN 'overlap' END] FROM messages WHERE doc_id % 4 = 0)"""


@query(f"WITH {TRAINING_SQL} SELECT part, doc_id::VARCHAR AS row_key, unnest(list_filter(r, lambda x: x IS NOT NULL)) AS rule FROM v")
def c13_check_training_rows(spark, d):
    k, m = F.col("doc_id"), messages(spark, d)
    split = F.when(k % 23 == 0, "dev").when(k % 3 == 0, "test").otherwise("train")
    rows = m.select(k.alias("id"), "source", F.when(F.col("label").isNull() & (k % 2 == 0), "legitimate").otherwise(F.col("label")).alias("label"), "subject", "text_body", F.when(k % 19 == 0, "  ").otherwise(F.col("text_body")).alias("model_text"), split.alias("split"), F.col("source_hash").alias("content_fingerprint"))
    supplement = m.filter(k % 4 == 0).select((k + 1).alias("id"), "label", F.when(k % 8 == 0, "valid").alias("dataset_partition"), F.col("source_hash").alias("content_fingerprint"))
    return quality.training_violations(rows, m.filter(k % 5 == 0).select(k.alias("id"), "label"), supplement)


def _analysed(spark, d, docs=None):
    rows = rules.analysed(_ruled(spark, d, docs), views._digest(F.col("doc_id").cast("string")), **LISTS)
    return rows.withColumn("id", F.concat(F.lit("m"), F.col("doc_id").cast("string")))


ANALYSED = f"""{RULED}, s AS (SELECT doc_id, least(coalesce(list_sum(list_transform(codes, lambda c: {RULE_SCORES})), 0), 100.0)::DOUBLE AS rule_score, len(codes) AS hits, ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INTEGER::DOUBLE / 65535 AS p FROM codes),
  f AS (SELECT 'm' || doc_id::VARCHAR AS email_id, doc_id, hits, rule_score, p, round_even((0.65 * p + 0.35 * (rule_score / 100)) * 100, 1) AS final_score FROM s),
  verdicts AS (SELECT *, CASE WHEN final_score < 30 THEN 'low' WHEN final_score < 60 THEN 'medium' ELSE 'high' END AS risk_level, CASE WHEN p >= 0.5 THEN 'phishing' ELSE 'legitimate' END AS result_label FROM f)"""


@query(f"""WITH {ANALYSED} SELECT v.email_id, v.risk_level, v.final_score, sha256(d.text) AS file_hash, CASE WHEN r.domain <> '' THEN r.domain ELSE r.host END AS domain, r.hit AS blacklist_hit, 1 AS links, 1 AS attachments, v.hits FROM verdicts v JOIN documents d ON d.doc_id = v.doc_id
  JOIN (SELECT doc_id, registrable_domain AS domain, host, hit FROM ruled) r ON r.doc_id = v.doc_id""")
def a05_save_analysis(spark, d):
    """Analyses stored as four tables, and joined again."""
    folder = files.scratch(spark, "analyses")
    store.save_analyses(_analysed(spark, d), folder, 0)
    t = {name: store.stored(spark, folder, name) for name in store.TABLES}
    urls = t["email_urls"].groupBy("email_id").agg(F.min("domain").alias("domain"), F.max("blacklist_hit").alias("blacklist_hit"), F.count("*").cast("int").alias("links"))
    added = t["attachments"].groupBy("email_id").agg(F.count("*").cast("int").alias("attachments"))
    hits = F.size(F.from_json("hits", "array<struct<code:string>>")).cast("long").alias("hits")
    rows = t["detections"].select("email_id", "risk_level", "final_score", hits).join(t["emails"].select("email_id", "file_hash"), "email_id")
    return rows.join(urls, "email_id").join(added, "email_id")


@query(f"WITH {ANALYSED} SELECT email_id, risk_level, result_label, final_score, rule_score FROM verdicts")
def j01_score_stream(spark, d):
    """The documents as a stream: each batch is scored like the whole table, and stored."""
    folder = files.scratch(spark, "stream")
    docs = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")
    score_stream(docs, lambda batch: _analysed(batch.sparkSession, d, batch), folder, f"{folder}/checkpoint").awaitTermination()
    return store.stored(spark, folder, "detections").select("email_id", "risk_level", "result_label", "final_score", "rule_score")


def _arrivals(spark, d, name: str, arrival, count: int) -> tuple[str, list]:
    """A folder for a stream, and `count` jobs that each put the rows of one arrival (0, 1, …) into it."""
    folder = files.scratch(spark, "arrivals")
    rows = table(spark, d, name).withColumn("_k", arrival)
    return folder, [lambda k=k: rows.filter(F.col("_k") == k).drop("_k").write.mode("append").parquet(folder) for k in range(count)]


def _probabilities(stack: multiview.StoredStack, d, docs, keep: list[str]):
    """The documents as messages, with the columns of keep and the stored stack's probabilities."""
    rows = intents.with_intent_features(features.with_structure(_with_page(docs.sparkSession, d, docs)), "char_text")
    kept = rows.withColumns({"_urls": F.col("urls"), "_warnings": F.col("parse_warnings")})  # cleaning has columns of these names
    rows = text.with_model_text(kept).withColumns({"urls": F.col("_urls"), "parse_warnings": F.col("_warnings")}).drop("_urls", "_warnings")
    return stack.scored(rows, files.scratch(docs.sparkSession, "featured"), keep)


#: What rules, verdicts and stored analyses read of a message.
ANALYSED_COLUMNS = ["doc_id", "file_hash", "subject", "text_body", "sender", "reply_to", "urls", "attachments", "parse_warnings"]


def _scored_by(stack: multiview.StoredStack, d, docs):
    """The documents as messages, with the stored stack's probabilities, rules and verdict."""
    out = rules.analysed(_probabilities(stack, d, docs, ANALYSED_COLUMNS), F.col("probability"), **LISTS)
    return out.withColumns({"id": F.concat(F.lit("m"), F.col("doc_id").cast("string")), "model_version": F.lit(stack.version)})


@query(f"WITH {ANALYSED} SELECT email_id, rule_score, 2 AS batches, true AS same_as_batch, true AS follows_model FROM verdicts, (SELECT 1)")
def j01_score_by_stored_stack(spark, d):
    """Documents that arrive in two batches, scored by a stack that was fitted on the labelled ones and saved, and stored.

    same_as_batch: the probability is that of scoring all documents at once. follows_model: final score, level, label and version follow from the
    stored probability, the rule score and the stack.
    """
    stack = _stack(spark, d).save(files.scratch(spark, "stack"))
    target, (folder, arrive) = files.scratch(spark, "scored"), _arrivals(spark, d, "documents", F.col("doc_id") % 2, 2)
    for put in arrive:
        put()
        stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(folder)
        score_stream(stream, lambda batch: _scored_by(stack, d, batch), target, f"{target}/checkpoint").awaitTermination()
        files.freed(spark)
    whole = _probabilities(stack, d, table(spark, d, "documents"), ["doc_id"]).select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("email_id"), F.col("probability").alias("_p"))
    rows = store.stored(spark, target, "detections").join(whole, "email_id", "left")
    p = F.col("model_probability")
    follows = (F.col("final_score") == rules.fused(p, F.col("rule_score"))) & (F.col("risk_level") == rules.risk_level(F.col("final_score"))) & (F.col("result_label") == rules.result_label(p)) & (F.col("model_version") == stack.version)
    batches = F.lit(store.commits(spark, target).count())
    return rows.select("email_id", "rule_score", batches.cast("int").alias("batches"), (F.abs(p - F.col("_p")) < 1e-9).alias("same_as_batch"), follows.alias("follows_model"))


def _linked(spark, d, docs):
    """The documents as messages with the odd link of a page; only every third shows a user part, so that a link may be an indicator before it looks like one."""
    pages = table(spark, d, "pages").count()
    page = _odd_links(spark, d)
    bare = F.array_remove("suspicious_tokens", "userinfo")
    names = ["raw_url", "normalized_url", "scheme", "host", "registrable_domain", "port", "path", "query", "is_https", "uses_ip", "is_shortener"]
    link = page.select(F.col("page_id").alias("_p"), *names, F.col("suspicious_tokens").alias("_all"), bare.alias("_bare"))
    m = messages(spark, d, docs).withColumn("_p", F.floor(F.col("doc_id") / 2) % pages).join(link, "_p")
    tokens = F.when(F.col("doc_id") % 3 == 0, F.col("_all")).otherwise(F.col("_bare")).alias("suspicious_tokens")
    url = F.struct(*names, F.lit("").alias("display_text"), F.lit("").alias("display_domain"), tokens, F.lit(False).alias("blacklist_hit"))
    none = F.array().cast("array<struct<filename:string,risk_hints:array<string>>>").alias("attachments")
    sender = message.mailbox(F.lit("a@mail.example"))
    return m.select(F.col("doc_id").alias("arrival"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.col("source_hash").alias("file_hash"), "subject", "text_body", sender.alias("sender"), message.mailbox(F.lit("")).alias("reply_to"), F.array(url).alias("urls"), none, F.array().cast("array<string>").alias("parse_warnings"))


_HAS = lambda words: f"len(list_filter({_list(words)}, lambda p: contains(t, p))) > 0"
STATE_SQL = f"""{MESSAGES}, {ODD_LINKS.split(',\n  fresh AS')[0]}, low AS (SELECT m.doc_id, lower(m.subject || chr(10) || m.text_body) AS t, (m.doc_id // 2) % (SELECT count(*) FROM pages) AS page_id FROM messages m),
  arrived AS (SELECT low.*, s.url, s.host, s.domain, CASE WHEN s.page_id % 6 = 1 AND low.doc_id % 3 <> 0 THEN s.tokens - 1 ELSE s.tokens END AS tokens FROM low JOIN seen s ON s.page_id = low.page_id),
  firsts AS (SELECT url, min(doc_id) AS first FROM arrived WHERE tokens > 0 AND url NOT IN (SELECT indicator FROM indicators WHERE indicator_type = 'url') GROUP BY 1),
  active AS (SELECT DISTINCT indicator_type, indicator FROM indicators WHERE status = 'active'),
  judged AS (SELECT a.*, u.indicator IS NOT NULL OR r.indicator IS NOT NULL OR h.indicator IS NOT NULL AS known_hit, coalesce(f.first <= a.doc_id, false) AS auto_hit,
    CASE WHEN {_HAS(URGENT_WORDS)} THEN 10 ELSE 0 END + CASE WHEN {_HAS(SENSITIVE_WORDS)} THEN 15 ELSE 0 END + CASE WHEN len(list_filter({_list(BRAND_WORDS)}, lambda p: contains(t, p) AND NOT contains('mail.example', p))) > 0 THEN 10 ELSE 0 END AS base, f.url AS fresh_url
    FROM arrived a LEFT JOIN firsts f ON f.url = a.url LEFT JOIN active u ON u.indicator_type = 'url' AND u.indicator = a.url
    LEFT JOIN active r ON r.indicator_type = 'domain' AND r.indicator = a.domain AND a.domain <> '' LEFT JOIN active h ON h.indicator_type = 'domain' AND h.indicator = a.host)"""


@query(f"""WITH {STATE_SQL} SELECT 'm' || doc_id::VARCHAR AS email_id, known_hit OR auto_hit AS blacklist_hit, (base + CASE WHEN any_token THEN 10.0 ELSE 0 END + CASE WHEN known_hit THEN 40 ELSE 0 END)::DOUBLE AS first_rule_score,
  (base + CASE WHEN any_token THEN 10.0 ELSE 0 END + CASE WHEN known_hit OR auto_hit THEN 40 ELSE 0 END)::DOUBLE AS rule_score FROM (SELECT *, tokens > 0 AS any_token FROM judged)""")
def j02_score_with_indicators(spark, d):
    """Messages that arrive in three batches: their links add indicators, and each is judged with what it and those before it have added.

    first_rule_score: the rule score before that, with the known indicators alone.
    """
    known, count = views.indicators(spark, d), table(spark, d, "documents").count()
    target, (folder, arrive) = files.scratch(spark, "watched"), _arrivals(spark, d, "documents", F.floor(F.col("doc_id") * 3 / F.lit(max(count, 1))).cast("int"), 3)
    score = lambda rows: rules.analysed(rows, F.lit(0.5), **LISTS)
    for put in arrive:
        put()
        stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(folder)
        jobs.score_with_indicators(stream, lambda batch: _linked(batch.sparkSession, d, batch), known, score, target, f"{target}/checkpoint", parts=16).awaitTermination()
    before = jobs.with_indicator_hits(_linked(spark, d, table(spark, d, "documents")).withColumn("_row", F.col("arrival")), known)
    before = rules.evaluated(before, **LISTS).select(F.col("id").alias("email_id"), F.col("rule_score").alias("first_rule_score"))
    hit = store.stored(spark, target, "email_urls").groupBy("email_id").agg(F.max("blacklist_hit").alias("blacklist_hit"))
    return store.stored(spark, target, "detections").select("email_id", "rule_score").join(hit, "email_id").join(before, "email_id")


@query(f"""WITH {STATE_SQL} SELECT url AS indicator, first AS first_order, (first * 3) // (SELECT count(*) FROM documents) AS first_batch FROM firsts""")
def j02_indicator_state(spark, d):
    """The indicators that the messages of j02_score_with_indicators add: each with its first message."""
    known, docs = views.indicators(spark, d), table(spark, d, "documents")
    count = docs.count()
    state = KeyedTable(spark, files.scratch(spark, "state"), jobs.AUTO, "indicator", 16)
    rows = _linked(spark, d, docs)
    links = rows.select("arrival", F.explode("urls").alias("_u")).select("arrival", "_u.normalized_url", "_u.suspicious_tokens")
    for k in range(3):
        jobs.auto_indicators(state, links.filter(F.floor(F.col("arrival") * 3 / F.lit(max(count, 1))) == k), known, k, "arrival")
    return state.read().select("indicator", "first_order", "first_batch")


EVENT_ARRIVALS = 5
#: A tenth of the events comes up to twelve days late; arrivals hold six days each.
_ARRIVAL = "least(4, (datediff('day', DATE '2024-01-01', ts::DATE) + CASE WHEN event_id % 10 = 3 THEN 1 + event_id % 12 ELSE 0 END) // 6)"


@query(f"""WITH e AS (SELECT *, {_ARRIVAL} AS k FROM events), m AS (SELECT k, max(ts) AS newest FROM e GROUP BY 1), w AS (SELECT k, max(newest) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM m),
  j AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late, date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS closed FROM e JOIN w ON w.k = e.k)
  SELECT day, event_type, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM j WHERE closed GROUP BY 1, 2""")
def j03_counts_and_late_rows(spark, d):
    """A stream of events in five arrivals: the counts of days that are closed, and how many events came too late for them."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + F.when(F.col("event_id") % 10 == 3, 1 + F.col("event_id") % 12).otherwise(0)
    target, (folder, arrive) = files.scratch(spark, "counted"), _arrivals(spark, d, "events", F.least(F.lit(EVENT_ARRIVALS - 1), F.floor(day / 6)).cast("int"), EVENT_ARRIVALS)
    for put in arrive:
        put()
        stream = lambda: spark.readStream.schema(table(spark, d, "events").schema).parquet(folder)
        running = [jobs.count_stream(stream(), target, f"{target}/checkpoint-counts"), jobs.late_stream(stream(), target, f"{target}/checkpoint-late")]
        for q in running:
            q.awaitTermination()
    counts = spark.read.schema(jobs.DAY_COUNTS).parquet(f"{target}/counts")
    late = spark.read.parquet(f"{target}/late").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("late"))
    both = counts.join(late, ["day", "event_type"], "full")
    return both.select("day", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("late", F.lit(0)).alias("late"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 100 <> 7")
def a06_delete_from_partitions(spark, d):
    """Orders in a keyed table; the deletion rewrites only the partitions that hold one of the keys."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store_ = KeyedTable(spark, files.scratch(spark, "orders"), "o_orderkey long, o_custkey long, o_orderstatus string", "o_orderkey", 16)
    store_.put(orders.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus"))
    store_.delete(orders.filter("o_orderkey % 100 = 7").select(F.col("o_orderkey").cast("long").alias("o_orderkey")))
    return store_.read()


@query(UPSERT_SQL)
def a14_upsert_in_place(spark, d):
    """The manifest as a keyed table: new rows replace old ones in their partitions, and the first time is kept."""
    old, new = _manifests(spark, d)
    manifest = KeyedTable(spark, files.scratch(spark, "manifest"), "page_id long, url string, state string, first_seen long", "page_id", 16)
    manifest.put(old)
    manifest.put(new, lambda a, b: overview.upserted(a, b, "page_id", "first_seen"))
    return manifest.read()


SCALED_SQL = f"""{STRUCTURE_SQL}, x AS MATERIALIZED (SELECT doc_id, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in STRUCTURE_VALUES.items())} FROM n)"""


@query(f"""WITH {SCALED_SQL} SELECT doc_id, {', '.join(f'round((x.{k} - s.m_{k}) / s.d_{k}, 6) AS {k}' for k in STRUCTURE_VALUES)} FROM x,
  (SELECT {', '.join(f'avg({k}) AS m_{k}, coalesce(nullif(stddev_pop({k}), 0), 1) AS d_{k}' for k in STRUCTURE_VALUES)} FROM x) s""")
def i03_scaled_view(spark, d):
    path = files.scratch(spark, "structure")
    features.with_structure(_with_page(spark, d)).select("doc_id", *features.STRUCTURE).write.parquet(path)
    rows = spark.read.parquet(path)  # the moments and the scaled rows are made of the same numbers
    scaled = multiview.scaling(rows, features.STRUCTURE)
    return rows.select("doc_id", *(F.round(c, 6).alias(name) for name, c in scaled.items()))


def _view_rows(spark, d):
    """Labelled messages with all that the four views read; three fourths by hash train, the others test."""
    rows = _with_page(spark, d).join(messages(spark, d).select("doc_id", "label", "lang"), "doc_id").filter("label in ('legitimate', 'phishing')")
    rows = text.with_model_text(intents.with_intent_features(features.with_structure(rows), "char_text"))
    part = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, "test").otherwise("train")
    return rows.select(F.col("doc_id").alias("id"), "label", "lang", part.alias("part"), "model_text", "char_text", *features.STRUCTURE, *intents.intent_names())


_STACKS: dict[tuple[str, str], multiview.Stack] = {}


def _stack(spark, d) -> multiview.Stack:
    """The stack of a folder of tables; fitted once in an application, as several queries look at the same one."""
    key = spark.sparkContext.applicationId, d
    if key not in _STACKS:
        _STACKS[key] = multiview.Stack(_view_rows(spark, d), files.scratch(spark, "views"))
    return _STACKS[key]


@query()
def i05_stacked_oof(spark, d):
    """id, label, fold and each view's probability from models that have not seen the fold."""
    return _stack(spark, d).oof


@query()
def i06_fusion_weights(spark, d):
    """The weight of each view in the fusion of all four, none below 0."""
    return multiview.weights(_stack(spark, d).fusion())


@query()
def i08_predict_views(spark, d):
    """The test rows with each view's probability, the fused one, and the calibrated one."""
    return _stack(spark, d).predictions()


@query()
def i09_view_subsets(spark, d):
    """Metrics on the test rows, by language, of five choices of views."""
    return _stack(spark, d).ablation("lang")


@query()
def i10_multilabel_intent(spark, d):
    """Probabilities of the intents of all documents, guarded by the weak labels."""
    rows = table(spark, d, "documents").select("doc_id", "text").join(_tagged(spark, d).select("doc_id", "intents"), "doc_id")
    return multiview.multilabel(rows, "doc_id", "text", "intents", list(INTENT_WORDS), "benign_notice")
