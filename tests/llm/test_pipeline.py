"""The pipeline's stages on a small table, against what each stage's own operator says."""

import random

import corpus_pipeline
from sievegrid.llm import minhash_join
from sievegrid.llm.shared import written


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(150):
        text = " ".join(rng.choice(words) for _ in range(60))
        toxic, poor = i % 5 == 0, i % 5 == 1
        text = text + " zzscum zzmoron" if toxic else " ".join(w + "%%%" for w in text.split()) if poor else text
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000 + i, rows[i][1] + " end", "en", "s0", rows[i][4] + 4) for i in (2, 3, 4, 7)]
    rows.append((2000, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == docs.columns
        seen[name], docs = {r["doc_id"] for r in out.collect()}, out
    clean = {i for i in range(150) if i % 5 > 1}
    assert not any(i < 150 and i % 5 == 0 for i in seen["toxicity"]) and clean <= seen["toxicity"]
    assert not any(i < 150 and i % 5 == 1 for i in seen["quality"]) and clean <= seen["quality"]
    assert seen["near_dedup"] & {1002, 1003, 1004, 1007} == set() and clean <= seen["near_dedup"]
    assert seen["mixing"] <= seen["near_dedup"] and seen["packing"] == seen["mixing"]
    assert minhash_join.deduplicated(docs.filter("false") if "text" in docs.columns else spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("aeioumnrst") for _ in range(5)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [
        (None, a, "alone"), (None, b, "unnamed copy"), (None, b + " end", "unnamed copy"), (None, c, "copy of 1"), (1, c + " end", "one"),
        (7, d, "seven"), (7, e, "other seven"), (5, e + " end", "copy of other seven"), (8, f, "twice"), (8, f, "twice"),
        (None, None, "no text"), (None, " ", "blank"), (9, None, "nine"), (9, "", "other nine"),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, name string, _row int").repartition(3)
    out = corpus_pipeline.without_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = ["alone", "blank", "copy of other seven", "nine", "no text", "one", "other nine", "seven", "twice", "unnamed copy"]
    assert sorted(r["name"] for r in out.collect()) == kept
    found = minhash_join.near_duplicates(docs)
    assert found.count() == len(rows) and found.filter("kept").count() == len(kept)
    assert {(r["doc_id"], r["component_id"]) for r in found.filter("not kept").collect()} == {(None, None), (None, 1), (7, 5), (8, 8)}
