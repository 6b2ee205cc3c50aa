"""Golden rows and invariants of features, contexts, stored analyses, training checks and models over views."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import features, intents, message, rules, text, urls
from sievegrid.operators import bagged, models, multiview, quality
from sievegrid.plans import scoring
from sievegrid.sources import files, store

SF = "/root/testdata/sf0.001"


def test_structure_of_a_message(spark):
    page = "<p>Immediately confirm the bank account.</p><a href='http://192.0.2.10/login'>example.invalid</a><IMG src=x>"
    df = spark.createDataFrame([(1, "Urgent payment!", "Ärger 12?\nyes", page)], "id long, subject string, text_body string, html_body string")
    link = urls.with_parsed(spark.createDataFrame([(1, "http://192.0.2.10/login", "example.invalid")], "id long, raw string, shown string"), "raw", F.col("shown")).withColumn("display_domain", rules.display_domain(F.col("display_text")))
    lists = link.groupBy("id").agg(F.collect_list(F.struct(*[c for c in link.columns if c not in ("id", "raw", "shown")])).alias("urls"))
    df = df.join(lists, "id").withColumns({"sender": message.mailbox(F.lit("a@example.invalid")), "reply_to": message.mailbox(F.lit("b@outside.invalid")), "recipients": F.array(message.mailbox(F.lit("u@x.y"))), "headers": F.create_map(F.lit("a"), F.lit("b"))})
    df = df.withColumn("char_text", text.char_text("subject", "text_body"))
    r = features.with_structure(df).first()
    assert len(features.STRUCTURE) == 33
    want = {
        "subject_chars": 15, "body_chars": 13, "word_count": 5, "line_count": 3, "exclamation_count": 1, "question_count": 1, "url_count": 1, "ip_url_count": 1, "distinct_domain_count": 1, "https_url_ratio": 0, "display_link_mismatch_count": 1,
        "sender_present": 1, "reply_to_present": 1, "sender_reply_domain_mismatch": 1, "return_path_domain_mismatch": 0, "recipient_count": 1, "header_count": 1, "attachment_count": 0, "html_present": 1, "html_tag_count": 3, "html_link_count": 1, "html_image_count": 1,
        "suspicious_url_token_count": 3,
    }
    assert {k: r[k] for k in want} == want
    assert r["digit_ratio"] == pytest.approx(2 / 29) and r["non_ascii_ratio"] == pytest.approx(1 / 29) and r["uppercase_ratio"] == pytest.approx(2 / 21)


def test_structure_of_plain_text(spark):
    df = spark.createDataFrame([(1, None, "see https://example.invalid/login and bit.ly/x"), (2, "", None)], "id long, subject string, text_body string").withColumn("char_text", text.char_text("subject", "text_body"))
    got = {r["id"]: r for r in features.with_structure(features.with_text_links(df, "id")).collect()}
    assert (got[1]["url_count"], got[1]["shortener_url_count"], got[1]["https_url_ratio"], got[1]["sender_present"], got[1]["html_present"]) == (2, 1, 0.5, 0, 0)
    assert got[2]["url_count"] == 0 and got[2]["line_count"] == 2 and got[2]["uppercase_ratio"] == 0


def test_context_from_json(spark):
    whole = {"subject": "s", "sender": {"address": "a@b.c"}, "reply_to": {"address": ""}, "recipients": [{"address": "r@b.c", "is_valid": True}, {}, 5], "headers": {"x": "y"}, "parse_warnings": ["w"],
             "urls": [{"raw_url": "http://q/", "port": "no"}, {"host": "h"}, 7], "attachments": [{"filename": "f", "size": 3}, {"filename": ""}]}
    rows = [(1, json.dumps(whole), None), (2, "[1]", "{bad"), (3, "nonsense", json.dumps({"subject": "t"})), (4, None, None), (5, "{}", None)]
    got = {r["id"]: r["context"] for r in features.with_context(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b").collect()}
    c = got[1]
    assert (c["subject"], c["sender"]["address"], c["reply_to"], [x["address"] for x in c["recipients"]], c["headers"], c["parse_warnings"]) == ("s", "a@b.c", None, ["r@b.c"], {"x": "y"}, ["w"])
    assert [(u["raw_url"], u["normalized_url"], u["port"], u["is_https"], u["suspicious_tokens"]) for u in c["urls"]] == [("http://q/", "http://q/", None, False, [])]
    assert [(a["filename"], a["mime_type"], a["size"]) for a in c["attachments"]] == [("f", "application/octet-stream", 3)]
    assert got[2] is None and got[3]["subject"] == "t" and got[4] is None and got[5]["sender"]["address"] == "" and got[5]["urls"] == []


def test_training_rows(spark):
    schema = "id long, source string, label string, subject string, text_body string, model_text string, split string, content_fingerprint string"
    rows = spark.createDataFrame([(1, "s", "phishing", "", "", "t", "train", "f1"), (2, "s", "spam_other", "", "", " ", "dev", "f2")], schema)
    hard = spark.createDataFrame([(5, "spam_other"), (6, "legitimate")], "id long, label string")
    more = spark.createDataFrame([(7, "phishing", None, "f1"), (8, "phishing", "valid", "f9"), (9, None, "train", None)], "id long, label string, dataset_partition string, content_fingerprint string")
    got = sorted(tuple(r) for r in quality.training_violations(rows, hard, more).collect())
    assert got == [("hard", "6", "hard_negative"), ("rows", "2", "label"), ("rows", "2", "model_text"), ("rows", "2", "split"), ("supplement", "7", "overlap"), ("supplement", "8", "partition"), ("supplement", "9", "label")]
    with pytest.raises(ValueError):
        quality.training_violations(rows.drop("split"), hard, more)


def test_stream_stores_what_the_batch_scores(spark):
    got = sorted(tuple(r) for r in scoring.j01_score_stream(spark, SF).collect())
    batch = scoring._analysed(spark, SF).select(F.col("id").alias("email_id"), "risk_level", "result_label", "final_score", "rule_score")
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 100


def test_a_batch_is_stored_once_and_repeats_stay(spark, tmp_path):
    rows = scoring._analysed(spark, SF).limit(5)
    assert [store.save_analyses(rows, str(tmp_path), batch) for batch in (0, 0, 1)] == [True, False, True]
    assert {name: store.stored(spark, str(tmp_path), name).count() for name in store.TABLES} == dict.fromkeys(store.TABLES, 10)
    assert {r["batch_id"]: r["rows"]["emails"] for r in store.commits(spark, str(tmp_path)).collect()} == {0: 5, 1: 5}


def test_nothing_of_a_batch_is_seen_before_all_of_it(spark, tmp_path, monkeypatch):
    rows, folder = scoring._analysed(spark, SF).limit(5), str(tmp_path)
    assert store.stored(spark, folder, "emails").count() == 0
    store.save_analyses(rows, folder, 0)
    real = store.result_tables

    def broken(results, row_id):
        found = real(results, row_id)
        return found | {"attachments": found["attachments"].withColumn("filename", F.raise_error(F.lit("lost")).cast("string"))}

    monkeypatch.setattr(store, "result_tables", broken)
    with pytest.raises(Exception, match="lost"):
        store.save_analyses(rows, folder, 1)
    assert spark.read.parquet(f"{folder}/emails").count() == 10  # two tables of the broken batch are there
    assert {name: store.stored(spark, folder, name).count() for name in store.TABLES} == dict.fromkeys(store.TABLES, 5)
    monkeypatch.setattr(store, "result_tables", real)
    assert store.save_analyses(rows, folder, 1)
    assert {name: store.stored(spark, folder, name).count() for name in store.TABLES} == dict.fromkeys(store.TABLES, 10)
    assert store.swept(spark, folder) >= 2 and spark.read.parquet(f"{folder}/emails").count() == 10


def test_json_lines_blank_and_broken(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n   \n{"a": 2\n{"a": 3, "b": null}\n')
    schema = spark.createDataFrame([], "a int, b string").schema
    got = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema, corrupt=True).collect()
    assert sorted((r["a"] or 0, r[files.CORRUPT] or "") for r in got) in ([(0, '{"a": 2'), (1, ""), (3, "")], [(1, ""), (2, '{"a": 2'), (3, "")])


def test_csv_with_a_byte_order_mark_and_row_numbers(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('\ufefftext,label\n"two\nlines",1\n"a ""quoted"" word",0\nplain,9\n'.encode())
    got = files.read_labelled_csv(spark, str(tmp_path / "x.csv"), "text string, label string", "src", "label", {"1": "phishing", "0": "legitimate"}).orderBy("id").collect()
    assert [(r["id"], r["text"], r["label"]) for r in got] == [("src-000000", "two\nlines", "phishing"), ("src-000001", 'a "quoted" word', "legitimate")]


def test_experiments_are_read_once(spark, tmp_path):
    for run in (1, 2):
        files.append_once(spark.createDataFrame([("e1", run), (f"e{run + 1}", run)], "experiment_id string, run int"), str(tmp_path), "experiment_id")
    assert sorted(tuple(r) for r in files.read_once(spark, str(tmp_path), "experiment_id", "run").collect()) == [("e1", 1), ("e2", 1), ("e3", 2)]


@pytest.fixture(scope="module")
def stack(spark):
    bad = ["Urgent: verify your password immediately", "Confidential wire transfer request now", "Approve sign-in with this device code", "Download and open the attachment now"]
    good = ["Weekly project meeting agenda", "Can we have lunch tomorrow", "The release was completed", "Lecture room changed for next week"]
    rows = [(i, "phishing" if i % 2 else "legitimate", "en", "test" if i // 8 % 4 == 3 else "train", f"{(bad if i % 2 else good)[i // 2 % 4]} {i}") for i in range(64)]
    df = spark.createDataFrame(rows, "id long, label string, lang string, part string, text_body string").withColumn("subject", F.lit("hello"))
    df = df.withColumn("char_text", text.char_text("subject", "text_body")).withColumn("model_text", F.col("char_text"))
    df = intents.with_intent_features(features.with_structure(df), "char_text")
    return multiview.Stack(df.select("id", "label", "lang", "part", "model_text", "char_text", *features.STRUCTURE, *intents.intent_names()), files.scratch(spark, "views"))


def test_out_of_fold_rows_and_fusion(stack):
    oof = stack.oof.collect()
    assert len(oof) == 48 and len({r["id"] for r in oof}) == 48 and {r["fold"] for r in oof} == set(range(5)) and stack.folds == 5
    assert all(0 <= r[f"p_{v}"] <= 1 for r in oof for v in multiview.VIEWS)
    weights = {r["view"]: r["weight"] for r in multiview.weights(stack.fusion()).collect()}
    assert list(weights) == multiview.VIEWS and min(weights.values()) >= 0 and max(weights.values()) > 0
    assert [r["view"] for r in multiview.weights(stack.fusion(["word", "char"])).collect()] == ["word", "char"]


def test_predictions_and_ablation(stack):
    got = stack.predictions().collect()
    assert len(got) == 16 and all(0 <= r["probability"] <= 1 and 0 <= r["fused"] <= 1 for r in got)
    assert sum((r["probability"] >= 0.5) == (r["label"] == "phishing") for r in got) >= 15
    rows = stack.ablation("lang").collect()
    assert {r["variant"] for r in rows} == set(multiview.VARIANTS) and all(r["support"] == 16 for r in rows)


def test_a_label_of_one_row_is_an_error(spark, stack):
    rows = spark.read.parquet(f"{stack.folder}/rows")
    with pytest.raises(ValueError):
        multiview.Stack(rows.filter("label = 'phishing' or id = 0"), files.scratch(spark, "views"))


def test_multilabel_constant_and_learnt(spark):
    rows = [(i, "send the password now" if i % 2 else "lunch at noon", ["ask"] if i % 2 else ["note"], ) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string, labels array<string>")
    got = {r["id"]: r for r in multiview.multilabel(df, "id", "t", "labels", ["ask", "never", "note"], "note").collect()}
    assert len(got) == 30 and all(r["p_never"] == 0.0 for r in got.values())
    assert all((r["p_ask"] >= 0.8) if i % 2 else (r["p_ask"] <= 0.2 and r["p_note"] >= 0.8) for i, r in got.items())


@pytest.mark.parametrize("at_once", [1, 7, 100_000])
def test_bags_are_the_counts_of_the_most_frequent_grams(spark, monkeypatch, at_once):
    monkeypatch.setattr(models, "WORDS_AT_ONCE", at_once)
    texts = ["abc de abc straße 漢字漢字 xx", "", None, "xx abcd abc \U00010400\U00010400a", "de 漢字 " * 9, "lonely lonely lonely", "\U00010400\U00010400a straße"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = df.select("id", text.tokens("t").alias("w"))
    counts = models.term_counts(df, "id", "t", models.char_grams)
    for most in (1000, 12):
        known = models.frequent_char_terms(rows, "id", "w", most)
        assert sorted(known) == sorted(r["term"] for r in multiview.known_terms(multiview.term_totals(counts), len(texts), most).collect()) and len(known) > 11
        got = {(r["id"], known[k], round(x, 9)) for r in models.char_bags(rows, "w", known).collect() for k, x in zip(r["bag"]["indices"], r["bag"]["values"], strict=True)}
        want = {(r["id"], r["term"], round(1 + math.log(r["c"]), 9)) for r in counts.collect() if r["term"] in known}
        assert got == want
    bags = models.char_bags(rows, "w", []).collect()
    assert len(bags) == len(texts) and not any(r["bag"]["indices"] for r in bags)


def test_scaling_of_equal_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in df.select(*multiview.scaling(df, ["a", "b"]).values()).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_terms_of_folds_come_from_one_count(spark):
    counts = spark.createDataFrame([(k, f"t{t}", 1 + (k * t) % 3) for k in range(12) for t in range(6) if (k + t) % 3], "id long, term string, c long")
    folds = spark.createDataFrame([(k, k % 3) for k in range(12)], "id long, fold int")
    totals = multiview.term_totals(counts.join(folds, "id"), "fold").filter("fold <> 1")
    seen = counts.join(folds.filter("fold <> 1"), "id")
    assert multiview.known_terms(totals, 8, 4).collect() == multiview.known_terms(multiview.term_totals(seen), 8, 4).collect()
    terms = multiview.known_terms(totals, 8, 4)
    vectors = multiview.text_vectors(folds, "id", counts, terms, 4)
    assert "to_json" not in vectors._jdf.queryExecution().optimizedPlan().toString()
    norms = [float(r["features"].norm(2)) for r in vectors.collect()]
    assert len(norms) == 12 and all(x == 0 or x == pytest.approx(1) for x in norms) and max(norms) > 0


def test_grams_are_those_of_the_array_function(spark):
    df = spark.createDataFrame([(1, "abc de abc straße 漢字漢字 xx"), (2, ""), (3, None)], "id long, t string")
    want = df.select("id", F.explode(models.char_grams(text.tokens("t"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    got = models.term_counts(df, "id", "t", models.char_grams)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_folds_share_one_gathering_of_terms(spark, stack):
    fitted = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{stack.folder}/known_word").select("path").collect()]
    assert fitted and set(stack.vectors) == {"word", "char"}  # one table of vectors a view, not one a fold
    counts = spark.read.parquet(f"{stack.folder}/terms_word")
    for fold in (0, None):
        seen, rows, kinds = stack._featured("word", fold)
        left = stack.train.filter(F.col("fold") != fold) if fold is not None else stack.train
        terms = multiview.known_terms(multiview.term_totals(counts.join(left.select("id"), "id")), left.count(), multiview.MOST_TERMS["word"])
        want = {r["term"]: r["idf"] for r in terms.collect()}
        assert {r["term"]: pytest.approx(r["idf"]) for r in kinds.collect()} == want
        named = {r["index"]: r["term"] for r in kinds.collect()}
        plain = {r["id"]: r["features"] for r in multiview.text_vectors(left.select("id", "y"), "id", counts, terms, len(want)).collect()}
        at = {r["term"]: r["index"] for r in terms.collect()}
        got = {r["id"]: r["features"] for r in seen.collect()}
        assert set(got) == set(plain) and rows.count() == (16 if fold is None else stack.train.filter(F.col("fold") == fold).count())
        for i, v in got.items():
            assert {at[named[k]]: pytest.approx(x) for k, x in zip(v.indices, v.values, strict=True) if x} == dict(zip(plain[i].indices, plain[i].values, strict=True))


def test_signs_and_words_are_counted_without_a_string_of_each(spark):
    odd = ["", "a b c. \n!!", "\U0001f600 İª١ éx a_b-- 漢字 \U00010400Z", "  ", "x", "a@b.com.x@c.de Q9", None]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, char_text string").withColumns({"subject": F.lit(""), "text_body": F.lit("")})
    got = features.with_structure(df)
    n, t = (lambda p: F.regexp_count("t", F.lit(p)).cast("double")), F.coalesce("char_text", F.lit(""))
    share = lambda p, whole: F.coalesce(F.try_divide(n(p), whole), F.lit(0.0))
    want = df.withColumn("t", t).select("id", n(r"(?U)\w+"), share(r"[^\x00-\x7F]", F.length("t")), share(r"\p{Lu}", n(r"\p{L}")), share(r"\p{Nd}", F.length("t")), n(features.ADDRESS_IN_TEXT))
    names = ["word_count", "non_ascii_ratio", "uppercase_ratio", "digit_ratio", "email_address_count"]
    assert sorted(map(tuple, got.select("id", *names).collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"regexp_extract_all(char_text#{p}" in plan for p in "0123456789") and plan.count("\\p{L}") == plan.count("[^\\p{L}]+")


def test_models_fitted_in_passes_are_those_of_the_library(spark, monkeypatch):
    """The same objective as MLlib's on the same vectors; rows that a model doesn't see don't count, and a term may stand in a row more often than 16 bits can say."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(bagged, "TERMS_AT_ONCE", 40)
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 6 + k % 5)) for k in range(60)] + ["", "zz " * 70_000]
    rows = [(k, t, int((k * 7) % 5 < 2 or "alpha" in t), k % 3) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string, y long, fold int").select("id", "y", "fold", text.tokens("t").alias("w"), F.lit(0).alias("group"))
    df = df.withColumn("ys", F.array(*(F.when(F.col("fold") != f, F.col("y")).otherwise(-1).cast("tinyint") for f in range(3))))
    known = models.frequent_char_terms(df, "id", "w", 40)
    bags = files.written(models.char_bags(df, "w", known, packed=True), "bags")
    dfs = bagged.row_counts(bags, len(known), 1)
    idf = np.log((1 + len(rows)) / (1 + dfs)) + 1
    bags = bagged.with_norms(bags, idf)
    counts = [tuple(sum(r[2] == y and r[3] != f for r in rows) for y in (0, 1)) for f in range(3)]
    monkeypatch.setattr(bagged, "TOLERANCE", 1e-9)
    monkeypatch.setattr(bagged, "MOST_STEPS", 1000)
    found = bagged.fitted(bags, idf, counts)
    p = {r["id"]: r["p"] for r in found.probabilities(bags, ["id"]).collect()}
    vectors, plain = [], {r["id"]: r["bag"] for r in models.char_bags(df, "w", known).collect()}
    for k, _, y, fold in rows:
        x = np.zeros(len(known))
        x[plain[k]["indices"]] = plain[k]["values"]
        x = x * idf[0]
        vectors.append((k, float(y), fold, Vectors.dense(x / (np.linalg.norm(x) or 1))))
    table = spark.createDataFrame(vectors, ["id", "y", "fold", "features"]).coalesce(1)
    for f in range(3):
        seen = models.class_weights(table.filter(F.col("fold") != f), "y")
        want = LogisticRegression(labelCol="y", weightCol="weight", regParam=0.01, maxIter=1000, tol=1e-12).fit(seen)
        assert np.abs(found.weights[f] - want.coefficients.toArray()).max() < 1e-3 and abs(found.intercepts[f] - want.intercept) < 1e-3
        for r in want.transform(table).collect():
            assert abs(p[r["id"]][f] - r["probability"][1]) < 1e-4


def test_scores_keep_what_is_asked_and_bags_are_packed(spark, stack, tmp_path):
    assert all({"places", "times", "norms"} <= set(v.columns) for v in stack.vectors.values())  # one packed table a view, for all folds
    saved = stack.save(str(tmp_path / "stack"))
    out = saved.scored(spark.read.parquet(f"{stack.folder}/rows"), str(tmp_path / "rows"), ["id"])
    assert out.columns == ["id", *(f"p_{v}" for v in multiview.VIEWS), "fused", "probability"] and spark.read.parquet(str(tmp_path / "rows")).count() == 64
    want = {r["id"]: r["probability"] for r in stack.predictions().collect()}
    assert all(abs(r["probability"] - want[r["id"]]) < 1e-9 for r in out.collect() if r["id"] in want)
