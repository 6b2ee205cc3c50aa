"""Golden rows and invariants for corpus, metric, indicator and stream operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sievegrid.functions import text
from sievegrid.operators import corpus, indicators, metrics, models, overview, quality, ranks
from sievegrid.streaming import jobs


def test_deduplicate_by_raw_hash_then_content(spark):
    rows = [("a", "h1", "x", "legitimate", [], 5), ("b", "h1", "x", "legitimate", ["w"], 9), ("c", "h2", "x", "legitimate", [], 4), ("d", "h3", "y", "legitimate", [], 4)]
    df = spark.createDataFrame(rows, "id string, source_hash string, content_fingerprint string, label string, parse_warnings array<string>, original_chars long")
    assert [r["id"] for r in corpus.deduplicated(df).orderBy("id").collect()] == ["a", "d"]
    r = corpus.dedup_report(df).first()
    assert (r["raw_hash_removed"], r["content_duplicate_removed"], r["retained_records"]) == (1, 1, 2)


def test_label_conflict_goes_whole(spark):
    rows = [("a", "h1", "x", "legitimate", [], 5), ("b", "h2", "x", "phishing", [], 5)]
    df = spark.createDataFrame(rows, "id string, source_hash string, content_fingerprint string, label string, parse_warnings array<string>, original_chars long")
    assert corpus.deduplicated(df).count() == 0
    assert corpus.dedup_report(df).first()["label_conflict_records_dropped"] == 2


def test_holdout_sizes(spark):
    df = spark.range(49).select("id", F.when(F.col("id") < 20, "a").when(F.col("id") < 40, "b").otherwise("c").alias("s"))
    got = {r["s"]: r["n"] for r in corpus.holdout(df, ["s"], "id").filter("held").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2, "b": 2}


def test_groups_are_never_divided(spark):
    df = spark.range(300).select("id", (F.col("id") % 100).cast("string").alias("g"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    out = corpus.group_split(df, "g", "label")
    assert corpus.mixed_groups(out, "g", "split").count() == 0
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()} == {"train": 70, "valid": 14, "test": 16}


def test_metrics(spark):
    df = spark.createDataFrame([("legitimate", 0.1), ("legitimate", 0.8), ("phishing", 0.6), ("phishing", 0.9)], "label string, probability double")
    r = metrics.classification(df).first()
    assert (r["false_positive_rate"], r["recall"], round(r["precision"], 6)) == (0.5, 1.0, 0.666667)
    assert round(metrics.average_precision(df).first()["pr_auc"], 6) == round((1 + 2 / 3) / 2, 6)
    one = metrics.average_precision(df.filter("label = 'phishing'")).first()["pr_auc"]
    assert one is None
    assert metrics.calibration_error(df.filter("false")).first()[0] == 0.0


def test_numbers_within_groups_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0, 1, 5, 7, 10**12, rng.randint(-50, 50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(5)
    got = {r["id"]: (r["place"], r["total"]) for r in ranks.numbered(df, ["g"], ranks.hash_order("id"), ranks.hash_bucket("id"), total="total").collect()}
    key = lambda r: (hashlib.sha256(f"|{r[0]}".encode()).hexdigest(), r[0])
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == g), key=key)
        assert [got[r[0]] for r in mine] == [(k + 1, len(mine)) for k in range(len(mine))]
    some = df.filter("v is not null")
    by_value = ranks.numbered(ranks.with_value_bucket(some, "v", "b"), ["g"], [F.col("v"), F.col("id")], F.col("b")).collect()
    for g in ("a", "b", None):
        mine = sorted((r["v"], r["id"], r["place"]) for r in by_value if r["g"] == g)
        assert [p for *_, p in mine] == list(range(1, len(mine) + 1))
    x = [float(r[2]) for r in rows if r[2] is not None]
    r = ranks.percentiles(df, "v", {"low": 0.0, "mid": 0.5, "most": 0.95, "high": 1.0}).first()
    assert tuple(r) == pytest.approx(tuple(np.percentile(x, [0, 50, 95, 100])))
    assert tuple(ranks.percentiles(df.filter("false"), "v", {"mid": 0.5}).first()) == (None,)


def test_near_duplicate_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(15)]
    rows = []
    for k in range(200):
        h = base[k % 15]
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        rows.append((f"k{k:03d}", f"{h:016x}"))
    classes = corpus.simhash_classes(spark.createDataFrame(rows, "key string, h string"), "key", "h")
    near = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count() <= 3
    least = {}
    for k, h in rows:
        least.setdefault(h, k)
    members = {least[h]: sum(x == h for _, x in rows) for h in least}
    brute = sorted((least[a], least[b], members[least[a]], members[least[b]]) for a in least for b in least if least[a] < least[b] and near(a, b))
    assert sorted(tuple(r) for r in corpus.near_duplicate_pairs(classes).collect()) == brute
    pairs = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if near(x, y)]
    assert tuple(corpus.near_duplicate_counts(classes).first()) == (len(pairs), len({k for p in pairs for k in p}))


def test_short_labels_and_mixed_groups_are_errors(spark):
    df = spark.createDataFrame([(1, "a", "g"), (2, "b", "g"), (3, "b", "h")], "id long, label string, g string")
    with pytest.raises(ValueError):
        corpus.balanced_cap(df, "label", "id", 4, least=2)
    with pytest.raises(ValueError):
        corpus.group_split(df, "g", "label", strict=True)


def test_identical_scores_have_no_bootstrap_difference(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 3 == 0, "phishing").otherwise("legitimate").alias("label"), (F.col("id") / 60).alias("candidate"), (F.col("id") / 60).alias("baseline"))
    r = metrics.paired_bootstrap(df, 20).first()
    assert (r["iterations"], r["ci95_lower"], r["ci95_upper"]) == (20, 0.0, 0.0)


def test_best_threshold_is_close_to_the_middle(spark):
    df = spark.createDataFrame([("legitimate", 0.1), ("phishing", 0.9)], "label string, probability double")
    assert metrics.best_threshold(df).first()["threshold"] == 0.5


def test_indicator_priority_and_hits(spark):
    links = spark.createDataFrame([(1, "https://a.b.example/x", "b.example", "a.b.example", "b.example"), (2, "https://c.example/", "c.example", "c.example", "c.example")], "k long, normalized_url string, registrable_domain string, host string, stored_domain string")
    known = [(1, "b.example", "domain", "active", 0.5), (2, "https://a.b.example/x", "url", "active", 0.9), (3, "a.b.example", "domain", "active", 0.1), (4, "c.example", "domain", "review", 0.1)]
    ind = spark.createDataFrame(known, "indicator_id long, indicator string, indicator_type string, status string, confidence double")
    got = {r["k"]: (r["indicator_id"], r["match_type"]) for r in indicators.matched(links, ind).collect()}
    assert got == {1: (2, "exact_url"), 2: (None, None)}
    assert {r["indicator_id"]: r["hits"] for r in indicators.hit_counts(ind, links).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}


def test_host_indicator_matches(spark):
    links = spark.createDataFrame([(1, "https://a.b.example/", "b.example", "a.b.example")], "k long, normalized_url string, registrable_domain string, host string")
    ind = spark.createDataFrame([(7, "a.b.example", "domain", "active", 0.5)], "indicator_id long, indicator string, indicator_type string, status string, confidence double")
    assert indicators.matched(links, ind).first()["indicator_id"] == 7


def test_derived_indicators(spark):
    df = spark.createDataFrame([("http://x.example/", ["ip_host", "encoded_chars", "login"]), ("http://y.example/", ["login", "shortener"])], "normalized_url string, suspicious_tokens array<string>")
    assert [(r["indicator"], r["confidence"]) for r in indicators.derived(df).collect()] == [("http://x.example/", 0.82)]
    known = spark.createDataFrame([("http://x.example/", "url")], "indicator string, indicator_type string")
    assert indicators.derived(df, known).count() == 0 and indicators.derived(df, known.withColumn("indicator_type", F.lit("domain"))).count() == 1


def test_bad_indicators(spark):
    df = spark.createDataFrame([(1, "a.example/x", "domain", 0.5), (2, "", "url", 2.0), (3, "a.example", "domain", None)], "indicator_id long, indicator string, indicator_type string, confidence double")
    assert sorted((r["row_key"], r["rule"]) for r in indicators.violations(df).collect()) == [("1", "domain_has_path"), ("2", "confidence_range"), ("2", "empty"), ("3", "confidence_range")]


def test_pages(spark):
    assert overview.pages(spark.range(0), 20).first()["pages"] == 0 and overview.pages(spark.range(41), 20).first()["pages"] == 3
    assert [r["id"] for r in overview.page(spark.range(10), [F.desc("id")], 2, 3).collect()] == [6, 5, 4]
    with pytest.raises(ValueError):
        overview.page(spark.range(3), [F.col("id")], 0, 3)


def test_upsert_keeps_the_first_time(spark):
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, t int"), spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "k int, v string, t int")
    assert [tuple(r) for r in overview.upserted(old, new, "k", "t").collect()] == [(1, "a", 5), (2, "c", 6), (3, "d", 9)]


def test_violations_take_null_as_broken(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "k int, p double")
    assert [(r["row_key"], r["rule"]) for r in quality.violations(df, "k", {"range": F.col("p").between(0, 1)}).collect()] == [("2", "range")]


def test_guardrails(spark):
    df = spark.createDataFrame([(["benign_notice"], 0.9, 0.1), (["legal"], 0.1, 0.1), ([], 0.5, 0.5)], "labels array<string>, p_legal double, p_benign_notice double")
    got = [(r["p_legal"], r["p_benign_notice"]) for r in models.guarded(df, ["legal", "benign_notice"], "labels", "benign_notice").collect()]
    assert got == [(0.2, 0.8), (0.8, 0.1), (0.5, 0.5)]


def test_non_negative_fusion(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense(k / 40, 1 - k / 40), float(k > 20 and k % 3 != 0)) for k in range(40)]
    model = models.balanced_logistic(spark.createDataFrame(rows, ["features", "y"]), non_negative=True)
    assert model.coefficients[0] > 0 and model.coefficients[1] >= 0


def test_indicator_stream_finds_what_earlier_batches_added(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    rows = [("http://x.example/", ["ip_host"]), ("http://y.example/", ["login"])]
    schema = "normalized_url string, suspicious_tokens array<string>"
    spark.createDataFrame([("http://old.example/", "url", 0.5)], "indicator string, indicator_type string, confidence double").write.parquet(f"{target}/batch_id=-1")
    for more in ([], [("http://x.example/", ["ip_host", "userinfo"]), ("http://old.example/", ["ip_host"]), ("http://z.example/", ["userinfo"])]):
        spark.createDataFrame([*rows, *more], schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.indicator_stream(stream, target, str(tmp_path / "check")).awaitTermination(60)
    got = sorted((r["indicator"], r["confidence"]) for r in spark.read.parquet(target).collect())
    assert got == [("http://old.example/", 0.5), ("http://x.example/", 0.77), ("http://z.example/", 0.77)]


def test_daily_counts_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.range(200).select((F.col("id") * 3600).cast("timestamp").alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"))
    events.write.parquet(str(tmp_path / "in"))
    stream = jobs.daily_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(spark.table("daily").collect()) == sorted(jobs.daily_counts(events).collect())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "label string, probability double")
    assert metrics.classification(empty).first()["f1"] == 0.0
    assert corpus.holdout(spark.createDataFrame([], "id long, s string"), ["s"], "id").count() == 0


def test_bootstrap_query_has_all_replicates(spark):
    r = queries()["e16_paired_bootstrap"](spark, "/root/testdata/sf0.001").first()
    assert r["iterations"] == 500 and r["ci95_lower"] <= r["mean_difference"] <= r["ci95_upper"]


def test_bootstrap_equals_brute_force(spark):
    rows = [(i, "phishing" if i % 3 == 0 else "legitimate", (i * 37 % 11) / 10, (i * 53 % 7) / 10) for i in range(30)]
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]

    def area(weights, score):
        every = sum(w for w, r in zip(weights, rows, strict=True) if r[1] == "phishing")
        total = tp = k = 0
        for s in sorted({r[score] for r in rows}, reverse=True):
            p = sum(w for w, r in zip(weights, rows, strict=True) if r[score] == s and r[1] == "phishing")
            tp, k = tp + p, k + sum(w for w, r in zip(weights, rows, strict=True) if r[score] == s)
            total += p / every * tp / k if k else 0
        return total

    differ = []
    for rep in range(1, 501):
        draws = [int(hashlib.md5(f"{i}|{rep}".encode()).hexdigest()[:8], 16) / 4294967296 for i in range(30)]
        weights = [sum(u >= s for s in steps) for u in draws]
        differ.append(area(weights, 2) - area(weights, 3))
    differ.sort()
    at = lambda q: (lambda x: differ[int(x)] + (x - int(x)) * (differ[int(x) + 1] - differ[int(x)]))(q * 499)
    r = metrics.paired_bootstrap(spark.createDataFrame(rows, "id int, label string, candidate double, baseline double")).first()
    assert r["iterations"] == 500 and r["mean_difference"] == pytest.approx(sum(differ) / 500)
    assert (r["ci95_lower"], r["ci95_upper"]) == (pytest.approx(at(0.025)), pytest.approx(at(0.975)))


def test_tfidf_counts_terms_where_the_text_is(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 40").select("doc_id", "text")
    for grams in (models.word_grams, models.char_grams):
        counts = models.term_counts(docs, "doc_id", "text", grams)
        assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        plain = docs.select("doc_id", text.tokens("text").alias("w")).select("doc_id", F.explode(grams("w")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("c"))
        assert counts.exceptAll(plain).count() == plain.exceptAll(counts).count() == 0
    whole = {(r["doc_id"], r["term"]): r["weight"] for r in models.tfidf(docs, "doc_id", "text").collect()}
    monkeypatch.setattr(models, "MOST_HOT", 5)  # nearly all terms are in the shuffle
    monkeypatch.setattr(models, "MOST_NORMS", 0)
    parts = {(r["doc_id"], r["term"]): r["weight"] for r in models.tfidf(docs, "doc_id", "text").collect()}
    assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k]) for k in whole)
    sums = {r["doc_id"]: r for r in models.tfidf_sums(docs, "doc_id", "text").collect()}
    for k, r in sums.items():
        mine = [w for (d, _), w in whole.items() if d == k]
        assert (r["terms"], r["total"], r["largest"]) == (len(mine), pytest.approx(sum(mine)), pytest.approx(max(mine)))
