"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import hmm, labelled, minhash_join, mixing, packing, quality_knn, sharding, simhash, textbytes, token_files, toxicity, vafile
from sievegrid.llm.shared import new_path, written
from sievegrid.llm.tokens import Encoder, tokenizer_path

random.seed(3)
WORDS = ["".join(random.choice("aeioumnrst") for _ in range(random.randint(2, 7))) for _ in range(120)]
BASE = "doc_id long, text string, lang string, source string, n_chars long, row long, g string, size long, k int"


def _text(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _texts():
    rng = random.Random(5)
    out = [None, "", "  \n\t ", "one", "One", "two words", "It's  odd\x1f 中文 ×÷ <|endoftext|> é", "a b  c\r\n\r\nd\te \n", _text(4000, rng)]
    for n in (40, 60, 200, 30, 90):
        t = _text(n, rng)
        w = t.split()
        w[3] = "changed"
        out += [t, t, " ".join(w), t.upper(), " ".join([*w[:20], "more", *w[20:]])]
    return out + [_text(rng.randint(3, 80), rng) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{min(i % 7, 2)}", len(t or ""), 7, "g", -1, 3) for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, BASE).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], BASE)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def library_ids(text):
    return [*Encoder.of(tokenizer_path()).library.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_round_trip(spark, docs, none):
    files = token_files.write(docs, new_path(spark, "files"))
    rows = token_files.read(spark, files, token_files.document_digests, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    start = 0
    for r, text in zip(sorted(rows, key=lambda r: r["doc_id"]), _texts(), strict=True):
        ids = library_ids(text)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    files = token_files.write(none, new_path(spark, "files"))
    assert token_files.read(spark, files, token_files.document_digests, "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 0


def test_token_files_keep_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "x"), (4, "b"), (4, "a"), (4, "a")], "doc_id long, text string")
    files = token_files.write(df, new_path(spark, "files"))
    rows = token_files.read(spark, files, token_files.document_digests, "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 4, 4, 4] and [r["start"] for r in rows] == [0, 2, 4, 6]


def test_packing_places_every_piece_once(docs, none):
    rows = packing.pack(docs, 64).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(_texts()):
        ids, at = library_ids(text), 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, crc(ids[at : at + r["length"]]))
            assert r["length"] == 64 or k == 0
            at += r["length"]
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * math.ceil(sum(r["length"] for r in rows) / 64) + 1
    assert packing.pack(none).count() == 0


def test_bin_plan_is_close_to_the_bound():
    rng = random.Random(1)
    for capacity in (10, 100, 1024):
        lengths = collections.Counter(rng.randint(1, capacity) for _ in range(5000))
        runs, bins = packing.plan_bins(lengths, capacity)
        used, placed = collections.defaultdict(list), collections.Counter()
        for length, rank, first, n, offset in runs:
            assert rank == placed[length] or rank < lengths[length]
            placed[length] += 0
            for k in range(n):
                used[first + k].append((offset, length))
        assert bins == len(used)
        assert bins <= 1.04 * sum(n * c for n, c in lengths.items()) / capacity + 1 or bins <= sum(c for n, c in lengths.items() if 2 * n > capacity) * 1.02 + 1


def plain_goals(names, sizes):
    """Targets one word at a time: words go to the source that is furthest below its weight, unless it is at twice its size."""
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    given, step = dict.fromkeys(names, 0.0), 0.25
    for _ in range(round(1.5 * sum(sizes.values()) / step)):
        free = [s for s in names if given[s] < 2 * sizes[s]]
        given[min(free, key=lambda s: given[s] / weight[s])] += step
    return given


def test_shard_draws_give_all_slots_out():
    slots = np.array([1000, 0, 17, 123456])
    drawn = [mixing.shard_counts(slots, 13, k) for k in range(13)]
    assert (sum(c for c, _ in drawn) == slots).all() and all((drawn[k][1] == sum((c for c, _ in drawn[:k]), np.zeros(4))).all() for k in range(13))
    assert max(abs(c[3] - 123456 / 13) for c, _ in drawn) < 6 * (123456 / 13) ** 0.5


def test_mixture_does_not_depend_on_the_files(docs):
    taken = lambda d: sorted((r["doc_id"], r["taken"]) for r in (lambda s, p: s.join(p.groupBy("row").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken")), "row"))(*mixing.mixed(d, block_words=8)).collect())
    assert taken(docs) == taken(docs.repartition(7).sortWithinPartitions(F.desc("doc_id")))


def test_mixture_targets_and_bounds(docs, none):
    sized, passages = mixing.mixed(docs, block_words=8)
    taken = passages.groupBy("row").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"))
    rows = sized.join(taken, "row", "left").fillna(0, ["taken"]).collect()
    sizes = collections.defaultdict(int)
    for r, text in zip(sorted(rows, key=lambda r: r["doc_id"]), _texts(), strict=True):
        assert r["size"] == len((text or "").encode().split())
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = plain_goals(names, sizes)
    assert sum(goals.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=1)
    got = collections.defaultdict(int)
    for r in rows:
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], pytest.approx(goals[r["source"]], abs=2))
        got[r["source"]] += r["taken"]
    assert all(abs(got[s] - goals[s]) <= 16 for s in names)
    assert mixing.mixed(none)[0].count() == 0 and mixing.mixed(none)[1].count() == 0


def test_mixed_documents_hold_the_taken_words(docs):
    out = mixing.mixed_documents(docs, block_words=8)
    assert out.columns == docs.columns
    again = mixing.mixed_documents(docs, block_words=8)
    rows = sorted((r["doc_id"], r["text"]) for r in out.collect())
    assert rows == sorted((r["doc_id"], r["text"]) for r in again.collect())
    texts = _texts()
    assert all(set(t.split()) <= set((texts[i] or "").split()) for i, t in rows if i != 6)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False)))
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(docs, none):
    got = by_id(minhash_join.near_duplicates(docs))
    for i, (n, component) in enumerate(brute_components(_texts())):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, i == component)
    assert minhash_join.near_duplicates(none).count() == 0


def test_near_copy_group_longer_than_a_block(spark):
    rng = random.Random(2)
    base, texts = [rng.choice(WORDS) for _ in range(80)], []
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(80)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    got = by_id(minhash_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(400)] == brute_components(texts)


def test_simhash_of_edited_texts(docs, none, spark):
    rows = by_id(simhash.compared(docs))
    texts = _texts()
    order = list(range(len(texts)))[::-1]
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        t, n = texts[i] or "", texts[j] or ""
        k = len(t) // 3
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        differ = sum((a ^ b).bit_count() for a, b in zip(r["print"], rows[j]["print"], strict=True))
        assert r["near_next"] == pytest.approx(1 - differ / simhash.BITS)
    assert rows[9]["print"] == rows[10]["print"] and simhash.compared(none).count() == 0


def plain_print(text):
    """Votes of the 2-word shingles, one by one; only the hash of a shingle is the operator's."""
    shingles, _ = simhash.pair_hashes(*simhash.word_hashes(pa.array([text])))
    votes = [0] * 128
    for h in shingles:
        for w in range(2):
            x = int(simhash.mix64(np.array([h]) ^ simhash._SALT[w])[0])
            for b in range(64):
                votes[64 * w + b] += 1 if x >> (63 - b) & 1 else -1
    return sum((v > 0) << (127 - k) for k, v in enumerate(votes)).to_bytes(16, "big")


def test_prints_and_likeness_equal_plain_ones(spark):
    texts = ["one two three two three", "one two three two four", "", None, "Word", "a b " * 40, "ä ö\nü"]
    rows = by_id(simhash.compared(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, print string")))
    for i, t in enumerate(texts):
        t, n = t or "", texts[i - 1] or ""
        k = len(t) // 3
        mine, edited, following = plain_print(t), plain_print(t[: len(t) - k] + n[:k]), plain_print(n)
        same = lambda a, b: 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / 128
        assert (bytes(rows[i]["print"]), bytes(rows[i]["edited_print"])) == (mine, edited)
        assert (rows[i]["near_edited"], rows[i]["near_next"]) == (same(mine, edited), same(mine, following))


def test_simhash_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x y"), (3, "b"), (3, "b"), (3, "a"), (None, None)], "doc_id long, text string")
    rows = simhash.compared(df).collect()
    assert len(rows) == 5 and sorted(r["n_chars"] for r in rows) == [0, 1, 1, 1, 3] and sum(r["near_next"] == 1.0 for r in rows) >= 1


def test_long_texts_in_pieces_equal_whole_ones(monkeypatch):
    rng = random.Random(11)
    texts = pa.array([_text(3000, rng), "short one", None, "x" * 9000, _text(500, rng)])
    whole = [textbytes.word_hashes(texts)[0], quality_knn.terms(texts), simhash.fingerprints(texts), *toxicity.features(texts)]
    for module in (textbytes, quality_knn):
        monkeypatch.setattr(module, "SLICE_BYTES", 700)
    monkeypatch.setattr(simhash, "_VOTERS_AT_ONCE", 50)
    pieces = [textbytes.word_hashes(texts)[0], quality_knn.terms(texts), simhash.fingerprints(texts), *toxicity.features(texts)]
    for a, b in zip(whole, pieces, strict=True):
        assert np.allclose(a, b) if a.dtype == np.float32 else (a == b).all()


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(4)
    base, prints = [rng.getrandbits(128) for _ in range(20)], []
    for k in range(300):
        x = base[k % 20]
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(128)
        prints.append(x.to_bytes(16, "big"))
    got = {bytes(r["key"]): r["near_class"] for r in simhash.linked(spark.createDataFrame([(bytearray(p), i) for i, p in enumerate(prints)], "key binary, first_id long"), 3).collect()}
    least = list(range(300))
    for _ in range(300):
        new = [min(least[j] for j in range(300) if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= 3) for i in range(300)]
        if new == least:
            break
        least = new
    assert [got[p] for p in prints] == least


def test_near_class_finds_edited_texts(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        w = ["".join(rng.choice("aeioumnrst") for _ in range(5)) for _ in range(200)]
        texts += [" ".join(w), " ".join([*w[:90], "changed", *w[91:]])]
    texts += ["", "a b c", "d e f"]
    prints = [p.tobytes() for p in simhash.fingerprints(pa.array(texts))]
    rows = spark.createDataFrame([(bytearray(p), i) for i, p in enumerate(prints)], "key binary, first_id long")
    got = {bytes(r["key"]): r["near_class"] for r in simhash.linked(rows).collect()}
    near = [got[p] for p in prints]
    assert sum(near[i] == near[i + 1] == i for i in range(0, 120, 2)) >= 57 and near[120:] == [120, 121, 122]
    bits = [int.from_bytes(p, "big") for p in prints]
    assert near[:120] == [min([i, *(j for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= simhash.RADIUS)]) for i in range(120)]


def test_long_lists_equal_short_ones(monkeypatch):
    rng = np.random.default_rng(6)
    prints = np.repeat(rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64), 20, axis=0)
    for _ in range(6):
        prints[np.arange(800), rng.integers(0, 2, 800)] ^= np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)
    mask = np.zeros(2, dtype=np.uint64)
    got = []
    for most in (1, 1000):
        monkeypatch.setattr(simhash, "_LONG", most)
        a, b = simhash.links_of_lists(prints, mask, simhash.radius_of(0.95))
        got.append(sorted(zip(map(tuple, a.tolist()), map(tuple, b.tolist()), strict=True)))
    assert got[0] == got[1] and len(got[0]) > 600


def test_hmm_base_and_likelihood(docs, none):
    got, texts = by_id(hmm.scored(docs)), _texts()
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    assert hmm.scored(none).count() == 0


def _random_model(rng, states, kinds):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(norm(rng.random(states)), norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, kinds))).T)


def _path_sums(model, s):
    """(probability, expected starts, moves, emits) of one sequence, over all paths of states."""
    k, total = len(model.start), 0.0
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros(model.emits.shape)
    for path in np.ndindex(*[k] * len(s)):
        p = model.start[path[0]] * model.emits[s[0], path[0]]
        for t in range(1, len(s)):
            p *= model.moves[path[t - 1], path[t]] * model.emits[s[t], path[t]]
        total += p
        starts[path[0]] += p
        for t in range(len(s)):
            emits[s[t], path[t]] += p
            if t:
                moves[path[t - 1], path[t]] += p
    return total, starts / total, moves / total, emits / total


def test_forward_and_counts_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    model = _random_model(rng, 3, 12)
    seq, sizes = np.array([5, 9, 5, 11, 7, 11]), np.array([4, 2])
    brute = [_path_sums(model, s) for s in (seq[:4], seq[4:])]
    assert hmm.log_likelihood(model, seq, np.array([0, 4]), sizes) == pytest.approx([math.log(p) for p, *_ in brute])
    starts, moves, emits, total = hmm.summed(model, seq, sizes)
    assert starts == pytest.approx(sum(x[1] for x in brute), rel=1e-4) and moves == pytest.approx(sum(x[2] for x in brute), rel=1e-4)
    assert emits == pytest.approx(sum(x[3] for x in brute), rel=1e-4) and total == pytest.approx(sum(math.log(x[0]) for x in brute), rel=1e-4)
    better = hmm.Model(starts / starts.sum(), model.occupied, moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    assert hmm.log_likelihood(better, seq, np.array([0, 4]), sizes).sum() > hmm.log_likelihood(model, seq, np.array([0, 4]), sizes).sum()


def test_segments_lose_no_token_and_no_move():
    rng = np.random.default_rng(1)
    model, sizes = _random_model(rng, 4, 30), np.array([1, 300, 70, 512, 33])
    model.moves = 0.5 * model.moves + 0.5 * np.eye(4)
    seq = rng.integers(0, 30, sizes.sum())
    cut, whole = hmm.expected_counts(model, seq, hmm.segments(sizes, 64, 16)), hmm.expected_counts(model, seq, hmm.segments(sizes, 1000, 0))
    assert cut[2].sum() == pytest.approx(sizes.sum(), rel=1e-5) and cut[1].sum() == pytest.approx((sizes - 1).sum(), rel=1e-5)
    for x, y in zip(cut[:3], whole[:3], strict=True):
        assert np.abs(x - y).max() < 0.02 * y.max()
    assert cut[3] == pytest.approx(whole[3], rel=1e-3)


def test_hmm_training_and_scores_over_partitions(spark, docs, monkeypatch):
    """One round over several blocks and tasks equals one over the classes of all texts, and scores equal the plain formula."""
    texts = _texts()
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tokens = [(t or "").encode().lower().split() for t in texts]
    count = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    monkeypatch.setattr(hmm, "LEAST_OWN", 16)
    monkeypatch.setattr(hmm, "OWN_GROWTH", 0.5)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 900)
    seen = {}

    def spied(table, names, plain=hmm.trained):
        seen["names"], seen["table"] = names, table
        seen["model"], seen["rounds"] = plain(table, names, most_rounds=1)
        return seen["model"], seen["rounds"]

    monkeypatch.setattr(hmm, "trained", spied)
    got = by_id(hmm.scored(docs))
    names, model = seen["names"], seen["model"]
    assert seen["table"].count() >= 3 and len(names.own) == 16
    hashed = {}
    for w in {w for t in tokens for w in t}:
        h, suffix, _ = hmm.word_tables(pa.array([w.decode()]))
        hashed[w] = int(names.of(h, suffix)[0])
    in_class, mass = collections.Counter(), collections.Counter()
    for w, n in count.items():
        in_class[hashed[w]] += n + 1
        mass[hashed[w]] += n
    assert all(names.mass[c] == n for c, n in mass.items()) and names.mass[-1] == held.count(False)
    seqs = [[*(hashed[w] for w in t), names.end] for t in tokens]
    kept = [s for s, h in zip(seqs, held, strict=True) if not h]
    group, pairs = names.groups(), np.zeros((hmm.COARSE, hmm.COARSE))
    for s in kept:
        for a, b in zip([names.end, *s[:-1]], s, strict=True):
            pairs[group[a], group[b]] += 1
    assert (hmm.neighbours(seen["table"], names) == pairs).all()
    first = hmm.first_states(pairs, names)
    plain = hmm.expected_counts(first, np.concatenate(kept), hmm.segments(np.array([len(s) for s in kept]), 10**6, 0))
    expected = hmm.estimated(*plain[:3], names.mass)
    assert model.moves == pytest.approx(expected.moves, abs=2e-3) and model.emits == pytest.approx(expected.emits, abs=2e-3)
    for i, s in enumerate(seqs):
        value = hmm.log_likelihood(model, np.array(s), np.array([0]), np.array([len(s)]))[0] / math.log(10)
        own = len(names.own)
        value += sum(math.log10((count[w] + 1) / (in_class[hashed[w]] + 1)) for w in tokens[i] if hashed[w] >= own)
        assert got[i]["score"] == pytest.approx(value)


def test_hmm_rounds_end_when_more_would_gain_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = written(hmm.blocks(docs), "blocks")
    names = hmm.classes(hmm.vocabulary(written(hmm.counted(table, 16), "answers")), docs.count())
    _, rounds = hmm.trained(table, names)
    _, more = hmm.trained(table, names, least_gain=-1.0, most_rounds=len(rounds) + 2)
    assert more[: len(rounds)] == pytest.approx(rounds) and rounds[1] > rounds[0]
    assert len(rounds) < hmm.MOST_ROUNDS and all(b - a < hmm.LEAST_GAIN for a, b in zip(more[len(rounds) - 1 :], more[len(rounds) :], strict=False))


def test_shards_are_even_and_keep_groups(spark, docs, none):
    rows = sharding.sharded(docs, 4).collect()
    assert len(rows) == len(_texts())
    sizes, slots, places = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        t = (_texts()[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        places[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in places.values())
    assert sharding.sharded(none).count() == 0


def test_group_over_capacity_is_split_evenly(spark):
    df = spark.createDataFrame([(i, "same text of a hot group" if i < 300 else f"text {i:05d}") for i in range(500)], "doc_id long, text string")
    sizes = collections.Counter()
    for r in sharding.sharded(df).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8


def test_va_file_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 6)) * 3, 2)
    x[50:120] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (380, [1.0, 2.0]), (400, []), (None, [1.0] * 6)]
    rows += [(420, [1e6, 1.0]), (421, [2e6, 1.0]), (440, [1.0]), (441, [2e9, -2.0]), (442, [2e9, -2.5])]  # far out of the range of the others
    rows += [(20, [0.5, -1.0, 2.0]), (20, [0.5, -1.0, 2.0]), (7, [4.0, 4.0])] + [(33, x[0].tolist())] * 30  # ids that repeat
    got = collections.defaultdict(list)
    for r in vafile.search(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, query int"), F.col("vec_id") % 20 == 0, 5).collect():
        got[r["query_id"], r["query"]].append((r["rank"], r["vec_id"], r["score"]))
    vectors = sorted({(i, tuple(math.floor(64 * c) for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)})
    brute = []
    for q, u in (p for p in vectors if p[0] % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for i, v in vectors if i != q)[:5]
        brute.append((q, [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]))
    assert sorted((q, sorted(found)) for (q, _), found in got.items()) == sorted(brute)
    assert vafile.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        vafile.search(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)


def test_va_file_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vafile.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, 2).collect()}
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 90, 3):
        scores = sorted((-int(x[q] @ x[i]), i) for i in range(90) if i != q)[:2]
        assert [got[q, 1], got[q, 2]] == [(i, -s) for s, i in scores]


def _labelled(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        t = _text(rng.randint(8, 60), rng)
        toxic, poor = i % 4 == 0, i % 5 == 1
        if toxic:
            t += " zzscum he zzmoron"
        elif i % 4 == 1:
            t += " she"
        if poor:
            t = " ".join(w + "%%%" for w in t.split())
        rows.append((i, t, int(toxic), int(not poor)))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, x, q) for i, _, x, q in rows] + [(None, 1, 0), (5, None, None)], "doc_id long, toxic int, quality int"), rows


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = _labelled(spark)
    got = by_id(toxicity.scored(docs, labels))
    assert len(got) == 402 and 0 <= got[900]["score"] <= 1 and got[900]["score"] == got[901]["score"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert all(got[i]["predicted"] == x for i, _, x, _ in rows)
    assert toxicity.scored(docs.filter("false"), labels).count() == 0
    assert by_id(toxicity.scored(docs, labels.filter("false")))[1]["predicted"] == 0


def _sparse(x):
    return toxicity.Sparse.of([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x], x.shape[1])


def test_swapped_terms_weigh_alike():
    x = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1], [0, 0, 1], [0, 0, 0]], dtype=float)
    y = np.array([1, 1, 0, 0, 0], dtype=float)
    d = np.array([[0, 1, -1]] * 4, dtype=float)
    free, _ = toxicity.fit(_sparse(x), y, _sparse(np.zeros((0, 3))))
    tied, _ = toxicity.fit(_sparse(x), y, _sparse(d), penalty=1000.0)
    assert free[1] - free[2] > 1 and abs(tied[1] - tied[2]) < 0.05


def test_fit_is_the_minimum():
    rng = np.random.default_rng(3)
    x = (rng.random((60, 7)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.random(60) > 1.2).astype(float)
    d = rng.integers(-1, 2, (20, 7)).astype(float)
    w, bias = toxicity.fit(_sparse(x), y, _sparse(d), ridge=0.01, penalty=0.5)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (share * (np.logaddexp(0, z) - y * z)).sum() + 0.01 * (v[:-1] ** 2).sum() + 0.5 * ((d @ v[:-1]) ** 2).mean()

    at = np.append(w, bias)
    assert all(loss(at) <= loss(at + e) for e in np.vstack([np.eye(8), -np.eye(8)]) * 1e-3)


def test_swaps_keep_to_the_language_and_reach_all_members():
    copies = toxicity.swapped("The Muslim is a doctor and the man of the house.")
    assert {w for c in copies for w in c.lower().split()} >= {"christian", "jewish", "hindu", "buddhist", "atheist", "woman", "person"}
    assert not any("jude" in c or "christ " in c for c in copies) and len(copies) == 5
    german = toxicity.swapped("Der Muslim ist ein Arzt und wohnt hier.")
    assert german == ["Der jude ist ein Arzt und wohnt hier.", "Der christ ist ein Arzt und wohnt hier."]
    assert toxicity.swapped("nothing here") == [] and toxicity.swapped("") == []


def test_labelled_sample_counts_a_doc_id_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(40)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert [(r["doc_id"], r["label"]) for r in labelled.sample(docs, labels, "toxic", 5).orderBy("doc_id").collect()] == [(1, 1), (2, 0)]


def test_quality_on_held_out_rows(spark):
    docs, labels, rows = _labelled(spark)
    got = by_id(quality_knn.scored(docs, labels))
    assert len(got) == 402 and got[900]["score"] == 0
    assert all(got[i]["predicted"] == q for i, _, _, q in rows)
    assert quality_knn.scored(docs.filter("false"), labels).count() == 0
    assert by_id(quality_knn.scored(docs, labels.filter("false")))[1]["score"] == 0


def test_quality_votes_equal_plain_ones(spark):
    """Terms counted one by one, cosines and votes in plain loops, in the fitted space."""
    docs, labels, rows = _labelled(spark)
    model = quality_knn.trained(docs, labels, each=40)
    got = by_id(quality_knn.scored(docs.withColumn("score", F.lit("x")).withColumn("label", F.lit(5)), labels, each=40))
    for i in (0, 3, 11, 26, 77):
        b = rows[i][1].encode()
        x = np.zeros(quality_knn.DIMENSIONS)
        for k in range(len(b) - 2):
            x[((b[k] * 961 + b[k + 1] * 31 + b[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 21] += 1
            kinds = [int(quality_knn._KIND[c]) for c in b[k : k + 3]]
            x[2048 + kinds[0] * 64 + kinds[1] * 8 + kinds[2]] += 1
        x /= len(b) - 2
        x[:2048] *= 0.5
        words = b.split()
        for k in (1, 2):
            share = sum(p == q for p, q in zip(words, words[k:], strict=False)) / len(words)
            x[2560 + 2 * k - 2 : 2560 + 2 * k] = share, 1 - share
        v = (np.sqrt(x) * model.weight) @ model.basis
        near = sorted(((float(v @ u) / np.linalg.norm(v), y) for u, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        votes = [(c**quality_knn.SHARPNESS, y) for c, y in near]
        assert got[i]["score"] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=0.01)


def test_toxicity_scores_equal_plain_ones(spark):
    docs, labels, rows = _labelled(spark)
    model = toxicity.trained(docs, labels)
    got = by_id(toxicity.scored(docs.withColumn("score", F.lit("x")).withColumn("f", F.lit(1)), labels))
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    for i in (0, 1, 8, 41):
        found = set()
        for w in re.findall(rb"[a-z\x80-\xff]+", rows[i][1].lower().encode()):
            whole = lambda s: int(textbytes.span_hashes(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0])
            found.add(whole(w))
            found |= {int(textbytes.mix64(np.array([whole(w[:n]) ^ n], dtype=np.uint64))[0]) for n in (4, 5, 6) if len(w) >= n}
        z = model.bias + sum(weight.get(f, 0.0) for f in found)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_shards_cut_hardly_more_links_than_a_plain_placing(spark):
    rng = random.Random(12)
    texts = [t for g in range(30) for t in [f"group {g} " + "w " * rng.randint(5, 60)] * rng.randint(2, 12)]
    texts += ["hot " + "x " * 20] * 150 + [f"single {i} " + "y " * rng.randint(0, 40) for i in range(200)]
    rng.shuffle(texts)
    rows = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()

    def cut(places):
        groups = collections.defaultdict(collections.Counter)
        for i, shard in places:
            groups[texts[i]][shard] += 1
        return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in groups.values())

    loads, plain = [0] * 8, []
    capacity = sum(len(t) + 1 for t in texts) / 8
    members = collections.defaultdict(list)
    for i, t in enumerate(texts):
        members[t].append(i)
    for t in sorted(members, key=lambda t: -len(members[t]) * len(t)):
        k = min(range(8), key=lambda k: loads[k])
        for i in members[t]:
            if loads[k] + len(t) + 1 > capacity * 1.02:
                k = min(range(8), key=lambda k: loads[k])
            loads[k] += len(t) + 1
            plain.append((i, k))
    assert cut((r["doc_id"], r["shard"]) for r in rows) <= 1.3 * cut(plain)
    again = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in rows if texts[r["doc_id"]].startswith("single")) == sorted((r["doc_id"], r["shard"]) for r in again if texts[r["doc_id"]].startswith("single"))


def test_encoder_equals_the_library():
    texts = [t or "" for t in _texts()] + ["  lead", "trail  ", "\n\n a\n  b\t c", "ab12 cd", "x" * 5000]
    e = Encoder.of(tokenizer_path())
    ids, off = e.ids(pa.array(texts))
    assert [ids[off[k] : off[k + 1]].tolist() for k in range(len(texts))] == [e.library.encode(t, add_special_tokens=False).ids for t in texts]
