"""Fill-in-the-middle, token alignment and quality rules against plain versions, with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import fill_in_middle, quality_rules, token_alignment, vafile
from sievegrid.llm.labelled import held_out
from sievegrid.llm.tokens import tokenizer_path
from tests.llm.plain import plain_alignment

SCHEMA = "doc_id long, text string, n long, pair long, block long, score double, form string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioumnrstß中") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(say(90) for _ in range(60))
    out = [None, "", "  \n\t ", "one", " one", "one ", "a\x1fb c\r\n\r\nd\te \n", "no <P> here", "<|endoftext|> <s> <0x41> ▁x", "ﬁ é́ ×÷", "#* 5%\n#* 5%\n \n#* 5%", "中" * 9000, " " * 9000 + "x" * 9000, long, "x " + long]
    out += [say(rng.randint(1, 120)) for _ in range(60)]
    out += [" ".join(rng.choice("ab") for _ in range(rng.randint(7, 60))) for _ in range(20)]
    return out + [out[40], out[40]]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(_texts())]
    return out + [(None, "without an id " * 30), (None, None), (3, "another text of three"), (3, "another text of three")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 0.5, "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _transformed(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_fill_in_middle_equals_plain_and_is_restored(docs, none, rows):
    out = fill_in_middle.transformed(docs)
    found = out.withColumn("back", fill_in_middle.restored(out["output"], out["form"])).collect()
    want = collections.Counter(_transformed(i, t) for i, t in rows)
    assert collections.Counter(tuple(r)[:-1] for r in found) == want
    assert collections.Counter(r["back"] for r in found) == collections.Counter(t or "" for _, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.transformed(none).count() == 0


def test_cuts_do_not_depend_on_what_the_memo_holds(rows):
    column = pa.array([t for _, t in rows])
    buf, off = fill_in_middle.packed(column)
    small, large = fill_in_middle.Memo(most=2000), fill_in_middle.Memo()
    for memo in (small, large, large):
        found = fill_in_middle.units(buf, off, memo)
        for i, (_, t) in enumerate(rows):
            units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t or "")
            assert found.n[i] == len(units)
            for k in {0, 1, len(units) // 2, len(units) - 1, len(units)} - {-1}:
                cut = "".join(units[:k])
                assert found.place(i, min(k, len(units))) == (len(cut.encode()), len(cut))
    assert len(small.of) < len(large.of)


def test_texts_that_share_a_passage_share_its_chunks():
    rng = random.Random(1)
    passage = "".join(rng.choice("abc de\n") for _ in range(40_000))
    cut = []
    for text in ("start " + passage, passage[:100] + "é" + passage):
        buf, off = fill_in_middle.packed(pa.array([text]))
        at = [*fill_in_middle.chunk_starts(buf, off).tolist(), len(buf)]
        cut.append({buf[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)})
    assert len(cut[0] & cut[1]) > 0.8 * len(cut[0]) and len(cut[0]) > 10


def test_token_alignment_equals_plain(docs, none, rows):
    want = plain_alignment([t for _, t in rows])
    expected = collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    found = token_alignment.measured(docs).collect()
    assert collections.Counter(tuple(r) for r in found) == expected
    assert sum(r["n_links"] for r in found) > 0 and token_alignment.measured(none).count() == 0


def test_token_alignment_over_many_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_ROWS", 3)
    texts = [t for _, t in rows][:9]
    first, second = token_alignment.ByteLevel.of(tokenizer_path()), token_alignment.Piecewise.of(tokenizer_path("piece_bpe_32k.model"))
    digits = token_alignment.Pieces([b"%d" % i for i in range(50_300)])
    made = []
    for k in range(0, 9, 3):
        block = token_alignment._Block()
        block.add(pa.array([0, 1, None], pa.int64()), token_alignment.align(pa.array(texts[k : k + 3]), first, second), digits, 1)
        made.append(block.row(k))
    total = collections.Counter()
    for b in made:
        total.update(dict(zip(np.frombuffer(b.column("pairs")[0].as_py(), "<i8").tolist(), np.frombuffer(b.column("counts")[0].as_py(), "<i8").tolist(), strict=True)))
    assert sum(total.values()) == sum(w[3] for w in plain_alignment(texts))


def test_spans_cover_the_text(docs, rows):
    for r in token_alignment.spans(docs).collect():
        for side in (r["a"], r["b"]):
            assert [t["start"] for t in side[1:]] == [t["end"] for t in side[:-1]]
            assert not side or side[0]["start"] == 0 and side[0]["group"] == 0
        ends = [{t["end"] for t in side} for side in (r["a"], r["b"])]
        assert len(ends[0] & ends[1]) == len({t["group"] for t in r["a"]}) == len({t["group"] for t in r["b"]})


def _counts(text):
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    marked = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), n < 20 or 100 * len(marked) > 30 * n


def test_quality_rules_count_like_plain(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    found = quality_rules.judged(docs, labels).collect()
    names = [*quality_rules.COUNTS, "base_failed"]
    assert collections.Counter((r["doc_id"], *(r[c] for c in names)) for r in found) == collections.Counter((i, *_counts(t)) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    no_labels = quality_rules.judged(docs, labels.filter("false")).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] > 0.999 for r in no_labels)
    assert quality_rules.judged(none, labels).count() == 0


def test_quality_rules_learn_and_keep_clean_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        bad = i % 4 == 0
        rows.append((i, " ".join(x + rng.choice(["***", "&&&"]) for x in w) if bad else " ".join(w) + "."))
        labels.append((i, int(not bad), 0))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality_rules.judged(docs, table).collect()
    assert any(r["held_out"] for r in found) and all(r["kept"] == (r["doc_id"] % 4 != 0) for r in found)
    forest = quality_rules.trained(docs, table)
    assert {r["doc_id"] for r in quality_rules.filtered(docs, forest).collect()} == {i for i in range(500) if i % 4}
    assert sum(r["held_out"] for r in found) == docs.filter(held_out()).count()


def test_forest_is_monotonic_and_fits():
    rng = np.random.default_rng(2)
    f = quality_rules.STATISTICS.index("symbols_a_word")
    x = rng.random((1500, len(quality_rules.STATISTICS))).astype(np.float32)
    y = ((x[:, f] + 0.6 * np.sin(12 * x[:, f]) + 0.3 * x[:, 0] < 0.6) ^ (rng.random(1500) < 0.05)).astype(float)  # not monotonic in truth
    forest = quality_rules.fit(x, y)
    base, last = x[:200].copy(), None
    for v in np.linspace(0, 1, 41):
        base[:, f] = v
        score = forest.scores(base)
        assert last is None or (score <= last + 1e-12).all()
        last = score
    free = quality_rules.STATISTICS.index("word_length")
    z = (np.abs(x[:, free] - 0.5) < 0.25).astype(float)
    assert ((quality_rules.fit(x, z).scores(x) > 0.5) == (z == 1)).mean() > 0.98
    one = quality_rules.fit(x, np.ones(1500))
    assert (one.scores(x) > 0.999).all() and len(one.roots) == 0


def test_va_file_with_many_own_vectors_on_top(spark, monkeypatch):
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(20, [10.0 + 0.1 * k, 10.0]) for k in range(30)] + [(3 + k, [1.0 + 0.01 * k, 1.0]) for k in range(5)] + [(9, [10.0, 10.0]), (40, [10.1, 10.0])]
    rows += [(60 + k, rng.normal(size=2).tolist()) for k in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in vafile.search(docs, F.col("vec_id") % 20 == 0, 4).collect():
        got[r["query_id"], r["query"]].append((r["rank"], r["vec_id"], r["score"]))
    vectors = sorted({(i, tuple(math.floor(64 * c) for c in v)) for i, v in rows})
    brute = []
    for q, u in (p for p in vectors if p[0] % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in vectors if i != q)[:4]
        brute.append((q, [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]))
    assert sorted((q, sorted(found)) for (q, _), found in got.items()) == sorted(brute) and len(brute) > 30
