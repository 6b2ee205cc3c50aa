"""Golden rows for text, link, message, rule and intent functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import intents, message, rules, text, urls


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def link(spark, raw):
    return urls.with_parsed(spark.createDataFrame([(raw,)], "u string"), "u").first()


def test_mask_before_full_stop(spark):
    r = text.with_masks(spark.createDataFrame([("Contact info@example.invalid.",)], "t string"), {"m": "t"}).first()
    assert (r["m"], r["m_emails"]) == ("Contact <EMAIL>.", 1)


def test_links_and_numbers_are_masked_after_addresses(spark):
    r = text.with_masks(spark.createDataFrame([("a@b.co at https://x.y/z?q=12345 and 123456 or a123456",)], "t string"), {"m": "t"}).first()
    assert r["m"] == "<EMAIL> at <URL> and <NUMBER> or a123456"
    assert (r["m_emails"], r["m_urls"], r["m_numbers"]) == (1, 1, 1)


def test_both_fields_empty(spark):
    r = text.with_model_text(spark.createDataFrame([("", "  \r\n  "), (None, None)], "subject string, text_body string")).collect()
    assert [x["model_text"] for x in r] == ["\n", "\n"]
    assert r[0]["parse_warnings"] == ["empty_subject", "empty_text_body"]


def test_truncation(spark):
    r = text.with_model_text(spark.createDataFrame([("", "x" * 20100)], "subject string, text_body string")).first()
    assert len(r["model_text"]) == 20000 and r["truncated"] and "model_text_truncated" in r["parse_warnings"]


def test_compatible_characters(spark):
    assert one(spark, text.normalized("t"), t="ﬁne  Ａ\r\n\r\n\r\n\r\nb") == "fine A\n\nb"


def test_bare_url(spark):
    u = link(spark, "Example.Invalid:8080/login?next=%2Fsecure")
    assert u["normalized_url"] == "http://example.invalid:8080/login?next=%2Fsecure" and u["port"] == 8080
    assert {"missing_scheme", "encoded_chars", "login", "secure"} <= set(u["suspicious_tokens"])


def test_default_port_and_fragment_go(spark):
    u = link(spark, "HTTPS://A.example.co.uk:443/p#x")
    assert (u["normalized_url"], u["port"], u["registrable_domain"]) == ("https://a.example.co.uk/p", None, "example.co.uk")


def test_bad_port(spark):
    u = link(spark, "http://a.example:99999/")
    assert u["normalized_url"] == "" and "parse_error" in u["suspicious_tokens"]


def test_address_host(spark):
    u = link(spark, "http://192.0.2.1/login")
    assert u["uses_ip"] and u["registrable_domain"] == "" and u["suspicious_tokens"] == ["non_https", "ip_host", "login"]


def test_lookalike_and_international_host(spark):
    assert "lookalike_characters" in link(spark, "https://g00gle.com/")["suspicious_tokens"]
    assert link(spark, "https://bücher.example/")["host"] == "xn--bcher-kva.example"


def test_user_part_is_not_the_host(spark):
    u = link(spark, "https://user:pw@host.example/x")
    assert (u["host"], u["normalized_url"]) == ("host.example", "https://host.example/x") and "userinfo" in u["suspicious_tokens"]


def test_address_like_text_gives_two_links(spark):
    assert one(spark, urls.found_urls("t"), t="first.last@mail.example.com") == ["first.last", "example.com"]


def test_attachment_hints(spark):
    hints = message.attachment_hints("f", "m")
    assert one(spark, hints, f="notice.pdf.exe", m="application/octet-stream") == ["risky_extension", "double_extension", "executable_like_content_type"]
    assert one(spark, hints, f="a.zip", m="") == ["archive_attachment"] and one(spark, hints, f=None, m=None) == []


def test_mailbox(spark):
    m = one(spark, message.mailbox("t"), t='"Ann B" <Ann@Example.org>')
    assert (m["display_name"], m["address"], m["domain"], m["is_valid"]) == ("Ann B", "ann@example.org", "example.org", True)
    assert not one(spark, message.mailbox("t"), t=None)["is_valid"]


def test_fusion_and_bands(spark):
    rows = spark.createDataFrame([(0.5, 0.0), (0.0, 0.0), (1.0, 100.0), (0.49, 100.0), (float("nan"), 1.0)], "p double, r double")
    got = rows.select(rules.fused(F.col("p"), F.col("r")).alias("s"), rules.result_label(F.col("p")).alias("l")).withColumn("b", rules.risk_level(F.col("s"))).collect()
    assert [(x["s"], x["b"]) for x in got[:3]] == [(32.5, "medium"), (0.0, "low"), (100.0, "high")]
    assert (got[3]["l"], got[3]["b"]) == ("legitimate", "high") and got[4]["s"] is None


def test_negation_leaves_the_benign_notice(spark):
    t = "Support will never ask for your verification code. No action is required."
    assert one(spark, intents.weak_intents(F.lower("t")), t=t) == ["benign_notice"]
    assert one(spark, intents.weak_intents(F.lower("t")), t="Please send me the password") == ["credential_request", "reply_or_data_request"]


def test_all_rules_are_capped(spark):
    box = "struct<display_name:string,address:string,domain:string,is_valid:boolean>"
    link_type = "struct<raw_url:string,normalized_url:string,display_text:string,display_domain:string,host:string,registrable_domain:string,suspicious_tokens:array<string>,blacklist_hit:boolean>"
    schema = f"subject string, text_body string, sender {box}, reply_to {box}, urls array<{link_type}>, attachments array<struct<filename:string,risk_hints:array<string>>>, parse_warnings array<string>"
    row = ("urgent", "send your password to paypal", ("", "x", "a.example", False), ("", "r@b.example", "b.example", True), [("u", "http://t.example/", "shown.example", "shown.example", "t.example", "t.example", ["non_https"], True)], [("f.exe", ["risky_extension"])], ["missing_date"])
    r = rules.evaluated(spark.createDataFrame([row], schema)).first()
    assert [h["code"] for h in r["hits"]] == [f"R{k:02d}" for k in range(1, 11)] and r["rule_score"] == 100.0


def test_fused_scores_round_tenths_half_even(spark):
    rows = spark.createDataFrame([(0.6, 59.0), (0.8, 1.0), (0.6, 41.0), (0.8, 23.0), (0.2, 41.0), (0.5, 50.0)], "p double, r double")
    assert [x["s"] for x in rows.select(rules.fused(F.col("p"), F.col("r")).alias("s")).collect()] == [59.6, 52.4, 53.4, 60.0, 27.4, 50.0]


def test_masks_of_texts_that_need_them_and_of_others(spark):
    odd = ["", "plain text\nof two lines", " led", "trailed\u2028", "two  blanks", "tab\there", "a \nb", "a\n b", "a\n\n\nb", "a\r\nb", "bell\x07", "\u00a0hard", "ﬁ１２３４５", "①", "x@y.example mail", "@ 12345", "123@y.example45678", "WWW.Example/1", "fTp://a", "1234 5", "١٢٣٤٥", "a12345", "http:// 99999 www.", None]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, t string")
    n0 = df.select("id", text.normalized("t").alias("t0"))
    n1 = n0.select("id", "t0", F.regexp_replace("t0", text.EMAIL, "<EMAIL>").alias("t1"))
    n2 = n1.select("*", F.regexp_replace("t1", text.URL, "<URL>").alias("t2"))
    want = n2.select("id", F.regexp_replace("t2", text.LONG_NUMBER, "<NUMBER>").alias("m"), F.regexp_count("t0", F.lit(text.EMAIL)).alias("m_emails"), F.regexp_count("t1", F.lit(text.URL)).alias("m_urls"), F.regexp_count("t2", F.lit(text.LONG_NUMBER)).alias("m_numbers"))
    got = text.with_masks(df, {"m": "t"})
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "[\\x00-\\x09" in got._jdf.queryExecution().optimizedPlan().toString()  # tidy texts aren't read by every pattern


@pytest.mark.parametrize("at_once", [1, 5, 100_000])
def test_simhash_without_a_shuffle(spark, monkeypatch, at_once):
    monkeypatch.setattr(text, "WORDS_AT_ONCE", at_once)
    odd = ["", None, "ab", "ab cd ab", "a b c", "straße 漢字 \U00010400\U00010400 ab", "ab " * 40 + "cd " * 41, "x", "Ab CD eF"]
    df = spark.createDataFrame([(k, t, [f"w{k}"]) for k, t in enumerate(odd)], "id long, t string, w array<string>")
    got = text.simhash64(df, "id", "t", "w")
    want = {}
    for r in df.select("id", text.tokens("t").alias("x")).collect():
        hashes = [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in r["x"]]
        want[r["id"]] = f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes)):016x}"
    assert {r["id"]: r["simhash"] for r in got.collect()} == want and all(r["w"] == [f"w{r['id']}"] for r in got.collect())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_placeholders_of_blank_texts_follow_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as driver

    texts = [None, "", " \n", "\t", "a  <URL>\nb 123456 x@y.zz"]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in driver.queries()["b33_placeholder_stats"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(driver.oracle_sql()["b33_placeholder_stats"]).fetchall())
    assert one(spark, text.placeholder_stats("t")["tokens"], t=" \n") == 0  # the reference's split() finds none
