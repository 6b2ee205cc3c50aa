"""A hidden Markov language model of words.

Latent states follow each other as a Markov chain; a state emits a word class, and a class emits its words by their
counts. The most frequent words are classes of their own, more of them the larger the vocabulary is; all others share
classes by the hash of their last three bytes. Every round of Baum-Welch covers all training documents: tasks take expected
counts of states and classes over their blocks, and Spark adds them up. Rounds end when a token's likelihood gains less than
LEAST_GAIN. The scaled forward recursion over a whole document gives its exact likelihood.

The rounds start from states that explain which class follows which. Pairs of neighbours are counted over all training
documents, by COARSE groups of classes; from seeded random states, expectation and maximisation on that table alone (its size is fixed) find
the states of the groups, and each class begins with those of its group.

Training walks through long documents in segments. A segment begins its recursions OVERLAP tokens before its first and
after its last token, so moves over the edges count too, from states that have forgotten where the walk began.

Each document ends with an end token. A word that training has not met takes its class's one slot for such words.

The corpus is written once as blocks: the distinct words of a block, and for each token its place among them. The words
of all blocks meet once, packed by parts of their hashes: a part counts its words over the corpus and answers each block.
So no task holds the whole vocabulary, and a word that every block has is one entry of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.labelled import held_out
from sievegrid.llm.shared import documents, written
from sievegrid.llm.textbytes import LOWER, U64, mix64, packed, slices, span_hashes, tidy, words

STATES = 8
#: Words with a class of their own: the next power of two of OWN_GROWTH times the root of the vocabulary's size, LEAST_OWN at least.
LEAST_OWN, OWN_GROWTH = 4096, 4.0
HASHED = 4096
#: Gain of a token's natural log-likelihood below which a round is the last one, and most rounds.
LEAST_GAIN, MOST_ROUNDS = 0.01, 30
#: Groups of classes whose pairs the start is fitted on, and the steps of that fit.
COARSE, COARSE_STEPS = 1024, 100
SEGMENT, OVERLAP = 256, 32
_SEGMENTS_AT_ONCE = 1024
BLOCK_TOKENS = 1_200_000
#: Pairs of a block and a word in a part.
_PART = 400_000
SMOOTHING = 20.0
SEED = 5
FOLDS, FOLD = 7, 2


def word_tables(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, suffix classes, number of words of each text)."""
    buf, off = packed(texts)
    buf = LOWER[buf]
    starts, ends, at = words(buf, off)
    h = span_hashes(buf, starts, ends)
    last = np.zeros(len(starts), dtype=np.uint64)
    for k in (1, 2, 3):
        last = last * U64(257) + np.where(ends - k >= starts, buf[np.maximum(ends - k, 0)].astype(np.uint64) + U64(1), U64(0))
    return h, (mix64(last) % U64(HASHED)).astype(np.uint16), np.diff(at)


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.binary()), ("suffixes", pa.binary()), ("counts", pa.binary())])


def blocks(docs: DataFrame) -> DataFrame:
    """block, doc_ids, held, sizes (words of each document), codes (uint32 for each token, packed), words (uint64), suffixes (uint16), counts (uint32, training only, packed)."""

    def cut(batches):
        from pyspark import TaskContext

        number, kept, total = TaskContext.get().partitionId() << 24, [], 0

        def block():
            ids, held, sizes = (sum((list(k[j]) for k in kept), []) for j in range(3))
            h, where, codes, often = np.unique(np.concatenate([k[3] for k in kept]), return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small codes, which pack well
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            h, codes = h[order], place[codes]
            suffix = np.concatenate([k[4] for k in kept])[where[order]]
            train = np.repeat(~np.array(held, dtype=bool), sizes)
            counts = np.bincount(codes[train], minlength=len(h))
            row = {"block": number, "doc_ids": ids, "held": held, "sizes": sizes, "codes": packed_codes(codes), "words": h.tobytes(), "suffixes": suffix.tobytes(), "counts": packed_codes(counts)}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for a, b in slices(batch.column(2)):
                h, suffix, sizes = word_tables(batch.column(2).slice(a, b - a))
                kept.append((batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), sizes.tolist(), h, suffix))
                total += len(h)
                if total >= BLOCK_TOKENS:
                    yield block()
                    number, kept, total = number + 1, [], 0
        if kept:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", FOLDS, FOLD).alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(cut), "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, codes binary, words binary, suffixes binary, counts binary")


def packed_codes(codes: np.ndarray) -> bytes:
    """The codes as four compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked_codes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _parts_of(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the order of parts, parts that occur, where each begins)."""
    part = (mix64(h) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    named, first = np.unique(part[order], return_index=True)
    return order, named, first


def counted(table: DataFrame, parts: int) -> DataFrame:
    """block, part, words, counts, suffixes: for each block the training counts (packed) of its words of a part, and in a row of block -1 each word of the part that training has met."""

    def deal(batches):
        for batch in batches:
            for block, w, c, s in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                h, suffix = np.frombuffer(w, U64), np.frombuffer(s, np.uint16)
                counts = unpacked_codes(c, len(h))
                order, named, first = _parts_of(h, parts)
                for a in range(0, len(named), 1000):
                    lists = [order[x:y] for x, y in zip(first[a : a + 1000], [*first[a + 1 : a + 1000], first[a + 1000] if a + 1000 < len(first) else len(order)], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(lists), block)), pa.array(named[a : a + 1000]), pa.array([h[k].tobytes() for k in lists], pa.binary()), pa.array([counts[k].tobytes() for k in lists], pa.binary()), pa.array([suffix[k].tobytes() for k in lists], pa.binary())],
                        names=["block", "part", "words", "counts", "suffixes"],
                    )

    def answer(group: pa.Table) -> pa.Table:
        of, lists = group["block"].to_pylist(), group["words"].to_pylist()
        size = np.array([len(w) // 8 for w in lists])
        h, where, inverse = np.unique(np.frombuffer(b"".join(lists), U64), return_index=True, return_inverse=True)
        c = np.bincount(inverse, weights=np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint32).astype(np.float64), minlength=len(h)).astype(np.int64)
        suffix = np.frombuffer(b"".join(group["suffixes"].to_pylist()), np.uint16)[where]
        edges = np.concatenate([[0], np.cumsum(size)])
        replies = [packed_counts(c[inverse[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        met = c > 0
        part, none = group["part"][0].as_py(), pa.nulls(len(of), pa.binary())
        one = {"block": pa.array([*of, -1], pa.int64()), "part": pa.array([part] * (len(of) + 1), pa.int64()), "words": pa.array([*none.to_pylist(), h[met].tobytes()], pa.binary())}
        return pa.table(one | {"counts": pa.array([*replies, c[met].tobytes()], pa.binary()), "suffixes": pa.array([*none.to_pylist(), suffix[met].tobytes()], pa.binary())})

    schema = "block long, part long, words binary, counts binary, suffixes binary"
    return table.select("block", "words", "counts", "suffixes").mapInArrow(deal, schema).groupBy("part").applyInArrow(answer, schema)


def packed_counts(counts: np.ndarray) -> bytes:
    """64-bit counts as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def vocabulary(answers: DataFrame) -> DataFrame:
    """h, c, suffix: the words of training with their counts, each once."""

    def listed(batches):
        for batch in batches:
            for w, c, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h, c, s = np.frombuffer(w, np.int64), np.frombuffer(c, np.int64), np.frombuffer(s, np.uint16)
                for a in range(0, len(h), 100_000):
                    z = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h[z]), pa.array(c[z]), pa.array(s[z].astype(np.int32))], names=["h", "c", "suffix"])

    return answers.filter("block = -1").select("words", "counts", "suffixes").mapInArrow(listed, "h long, c long, suffix int")


@dataclass
class Classes:
    """Word classes: own ones of frequent words first, then the shared ones, then the end."""

    own: np.ndarray  # sorted hashes
    own_suffix: np.ndarray  # suffix classes of the own words
    totals: np.ndarray  # of count + 1 over the words of each suffix class, and 1 for unknown ones
    mass: np.ndarray  # training count of each class
    tokens: int  # N
    kinds: int  # V

    @property
    def end(self) -> int:
        return len(self.mass) - 1

    def of(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = suffix.astype(np.int64) + len(self.own)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
            mine = self.own[at] == h
            out[mine] = at[mine]
        return out

    def groups(self) -> np.ndarray:
        """The coarse group of each class: the most frequent own ones and the end by themselves, all others by their suffix."""
        half, n = COARSE // 2, len(self.own)
        out = half + np.concatenate([self.own_suffix, np.arange(HASHED), [0]]).astype(np.int64) % half
        out[np.argsort(-self.mass[:n], kind="stable")[: half - 1]] = np.arange(min(n, half - 1))
        out[-1] = half - 1
        return out

    def word_share(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the probability of words with count c in their class."""
        shared = (cls >= len(self.own)) & (cls < self.end)
        return np.where(shared, np.log10((c + 1) / self.totals[np.clip(cls - len(self.own), 0, HASHED - 1)]), 0.0)


def classes(words_of_training: DataFrame, documents_of_training: int) -> Classes:
    sums = words_of_training.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("n")).first()
    most = max(LEAST_OWN, 1 << int(np.ceil(np.log2(max(1.0, OWN_GROWTH * sums["n"] ** 0.5)))))
    top = words_of_training.orderBy(F.desc("c"), "h").select("h", "c", "suffix").limit(most)
    own = {r["h"] % (1 << 64): (r["c"], r["suffix"]) for r in top.collect()}  # grows with the root of the vocabulary: 16 MB of state tables at 10^9 words
    frequent = words_of_training.sparkSession.createDataFrame([(h - (1 << 64) if h >= 1 << 63 else h,) for h in own], "h long")
    rest = words_of_training.join(F.broadcast(frequent), "h", "left_anti")
    totals, mass = np.ones(HASHED), np.zeros(len(own) + HASHED + 1)
    for r in rest.groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # HASHED rows
        totals[r["suffix"]] += r["c"] + r["n"]
        mass[len(own) + r["suffix"]] = r["c"]
    hashes = np.array(sorted(own), dtype=U64)
    mass[: len(hashes)] = [own[int(h)][0] for h in hashes]
    mass[-1] = documents_of_training
    return Classes(hashes, np.array([own[int(h)][1] for h in hashes], dtype=np.int64), totals, mass, int(sums["c"]) + documents_of_training, int(sums["n"]) + (documents_of_training > 0))


@dataclass
class Model:
    start: np.ndarray  # of a document
    occupied: np.ndarray  # anywhere in one
    moves: np.ndarray
    emits: np.ndarray  # classes x STATES


def _by_length(sizes: np.ndarray):
    """(order of sequences by falling length, how many are longer than t for each t)."""
    order = np.argsort(-sizes, kind="stable")
    longer = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    return order, longer


def log_likelihood(model: Model, seq: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of the probability of whole sequences seq[first : first + size], by the scaled forward recursion."""
    order, longer = _by_length(sizes)
    at, total = first[order], np.zeros(len(sizes))
    moves, emits = model.moves.astype(np.float64), model.emits
    alpha = np.tile(model.start, (len(sizes), 1))
    for t, n in enumerate(longer.tolist()):
        here = (alpha[:n] if t == 0 else alpha[:n] @ moves) * emits[seq[at[:n] + t]]
        scale = here.sum(axis=1)
        alpha = here / scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(sizes))
    out[order] = total
    return out


@dataclass
class Segments:
    """Stretches of documents that the recursions walk, and the part of each whose tokens and moves count."""

    first: np.ndarray  # place of the first token in the sequence
    size: np.ndarray
    opens: np.ndarray  # begins a document
    core: np.ndarray  # steps before the counted part
    until: np.ndarray  # steps before its end

    def part(self, z: slice) -> Segments:
        return Segments(self.first[z], self.size[z], self.opens[z], self.core[z], self.until[z])


def segments(sizes: np.ndarray, length: int = SEGMENT, overlap: int = OVERLAP) -> Segments:
    """The segments of documents that lie one after the other."""
    count = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    a, b = place * length, np.minimum((place + 1) * length, sizes[doc])
    x, y = np.maximum(a - overlap, 0), np.minimum(b + overlap, sizes[doc])
    return Segments((np.cumsum(sizes) - sizes)[doc] + x, y - x, x == 0, a - x, b - x)


def expected_counts(model: Model, seq: np.ndarray, walk: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(start, moves, emits) counts of the counted parts, and the natural log of their likelihood."""
    order, longer = _by_length(walk.size)
    walk, k = walk.part(order), len(model.start)
    at, opens, kinds = walk.first, walk.opens, len(model.emits)
    moves, emits = model.moves.astype(np.float32), model.emits.astype(np.float32)
    alphas, scales, total = [], [], 0.0
    for t, n in enumerate(longer.tolist()):
        before = np.where(opens[:, None], model.start, model.occupied).astype(np.float32) if t == 0 else alphas[-1][:n] @ moves
        here = before * emits[seq[at[:n] + t]]
        scale = here.sum(axis=1, keepdims=True)
        alphas.append(here / scale)
        scales.append(scale)
        inside = (walk.core[:n] <= t) & (t < walk.until[:n])
        total += float(np.log(scale[inside, 0], dtype=np.float64).sum())
    starts, trans, tokens, gammas = np.zeros(k), np.zeros((k, k)), [np.zeros(0, np.int64)], [np.zeros((0, k), np.float32)]
    beta = np.ones((0, k), dtype=np.float32)
    for t in range(len(longer) - 1, -1, -1):
        n, m = int(longer[t]), len(beta)
        if m < n:
            beta = np.vstack([beta, np.ones((n - m, k), dtype=np.float32)])
        inside = (walk.core[:n] <= t) & (t < walk.until[:n])
        every = inside.all()
        gamma, here = alphas[t] * beta, seq[at[:n] + t]
        tokens.append(here if every else here[inside])
        gammas.append(gamma if every else gamma[inside])
        if t:
            back = emits[here] * beta / scales[t]
            before = alphas[t - 1][:n]
            trans += model.moves * (before.T @ back if every else before[inside].T @ back[inside])
            beta = back @ moves.T
        else:
            starts = gamma[opens & inside].sum(axis=0)
        alphas.pop()
    tokens, gammas = np.concatenate(tokens), np.concatenate(gammas)
    return starts, trans, np.stack([np.bincount(tokens, weights=gammas[:, j], minlength=kinds) for j in range(k)], axis=1), total


def estimated(starts: np.ndarray, trans: np.ndarray, emits: np.ndarray, mass: np.ndarray) -> Model:
    """The model of expected counts, each state's classes smoothed towards those of the whole corpus."""
    q = (mass + 0.5) / (mass + 0.5).sum()
    b = (emits + SMOOTHING * q[:, None]) / (emits.sum(axis=0) + SMOOTHING)
    a = (trans + 0.5) / (trans + 0.5).sum(axis=1, keepdims=True)
    p = (starts + 0.5) / (starts + 0.5).sum()
    o = (emits.sum(axis=0) + 0.5) / (emits.sum(axis=0) + 0.5).sum()
    return Model(p, o, a, b)


def summed(model: Model, seq: np.ndarray, sizes: np.ndarray):
    """expected_counts() of all documents, some segments at a time; None without documents."""
    total, walk = None, segments(sizes)
    order = np.argsort(walk.size, kind="stable")
    for a in range(0, len(order), _SEGMENTS_AT_ONCE):
        got = expected_counts(model, seq, walk.part(order[a : a + _SEGMENTS_AT_ONCE]))
        total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
    return total


def _with_ends(cls: np.ndarray, codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class sequence of all documents with the end class after each, and their sizes."""
    seq = np.full(len(codes) + len(sizes), end, dtype=np.int64)
    seq[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = cls[codes]
    return seq, sizes + 1


def _training_sequence(row: dict, called: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Class sequence of the training documents of a block, and their sizes."""
    sizes, wanted = np.array(row["sizes"], dtype=np.int64), ~np.array(row["held"], dtype=bool)
    codes = unpacked_codes(row["codes"], int(sizes.sum()))[np.repeat(wanted, sizes)]
    return _with_ends(called.of(np.frombuffer(row["words"], U64), np.frombuffer(row["suffixes"], np.uint16)), codes, sizes[wanted], called.end)


def _rows_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_TRAINING = ["held", "sizes", "codes", "words", "suffixes"]


def neighbours(table: DataFrame, names: Classes) -> np.ndarray:
    """COARSE x COARSE counts of neighbouring groups over all training documents; before a document stands the end of one."""
    given = table.sparkSession.sparkContext.broadcast(names)

    def count(batches):
        called, total = given.value, np.zeros(COARSE * COARSE, dtype=np.int64)
        group = called.groups()
        for row in _rows_of(batches):
            seq, _ = _training_sequence(row, called)
            if len(seq):
                q = group[seq]
                total += np.bincount(np.append(group[-1], q[:-1]) * COARSE + q, minlength=COARSE * COARSE)
        there = np.flatnonzero(total)
        for a in range(0, len(there), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(there[a : a + 100_000]), pa.array(total[there[a : a + 100_000]])], names=["pair", "n"])

    sums = table.select(*_TRAINING).mapInArrow(tidy(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most COARSE squared rows
    out = np.zeros(COARSE * COARSE)
    out[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(COARSE, COARSE)


def first_states(pairs: np.ndarray, names: Classes, seed: int = SEED) -> Model:
    """States between neighbouring groups, fitted to their counts: a group leads to states, and a state to the next group."""
    rng, group = np.random.default_rng(seed), names.groups()
    after = pairs.sum(axis=0)[:, None]
    emits = rng.dirichlet(np.ones(STATES), size=COARSE) * (after + 1e-9)
    emits /= emits.sum(axis=0)
    leads, found = rng.dirichlet(np.full(STATES, 5.0), size=COARSE), emits
    for _ in range(COARSE_STEPS):
        ratio = pairs / np.maximum(leads @ emits.T, 1e-300)
        leads, found = leads * (ratio @ emits) + 0.1, emits * (ratio.T @ leads)
        leads /= leads.sum(axis=1, keepdims=True)
        emits = found + 1e-3 * after / max(pairs.sum(), 1.0) + 1e-12
        emits /= emits.sum(axis=0)
    share = (found + 1e-6) / (found + 1e-6).sum(axis=1, keepdims=True)
    return estimated(leads[group[-1]] * names.mass[-1], found.T @ leads, names.mass[:, None] * share[group], names.mass)


def trained(table: DataFrame, names: Classes, least_gain: float = LEAST_GAIN, most_rounds: int = MOST_ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over the training documents of the blocks: the model, and for each round the mean log-likelihood of a token before it."""
    spark, model, rounds = table.sparkSession, first_states(neighbours(table, names), names), []
    columns = [f"s{k}" for k in range(STATES)]
    while len(rounds) < most_rounds and (len(rounds) < 2 or rounds[-1] - rounds[-2] >= least_gain):
        given = spark.sparkContext.broadcast((model, names))

        def count(batches, given=given):
            now, called = given.value
            total = None
            for row in _rows_of(batches):
                got = summed(now, *_training_sequence(row, called))
                if got is not None:
                    total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
            if total is not None:
                all_rows = np.vstack([total[2], total[1], total[0][None], np.full((1, STATES), total[3])])  # classes, moves, start, likelihood
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(all_rows))), *(pa.array(np.ascontiguousarray(all_rows[:, k])) for k in range(STATES))], names=["i", *columns])

        sums = table.select(*_TRAINING).mapInArrow(tidy(count), "i long, " + ", ".join(f"{c} double" for c in columns))
        sums = sums.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).collect()  # a row for each class and state
        given.unpersist()
        every = np.zeros((len(names.mass) + STATES + 2, STATES))
        for r in sums:
            every[r["i"]] = r[1:]
        kinds = len(names.mass)
        if not every[:kinds].any():
            break
        rounds.append(float(every[-1, 0] / every[:kinds].sum()))
        model = estimated(every[-2], every[kinds:-2], every[:kinds], names.mass)
    return model, rounds


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def block_scores(row: dict, count: np.ndarray, model: Model, names: Classes) -> pa.Table:
    """The scores of a block's documents; count: training counts of its words."""
    h, sizes = np.frombuffer(row["words"], U64), np.array(row["sizes"], dtype=np.int64)
    codes = unpacked_codes(row["codes"], int(sizes.sum()))
    cls = names.of(h, np.frombuffer(row["suffixes"], np.uint16))
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    doc_sum = lambda per_word: np.bincount(of, weights=per_word[codes], minlength=len(sizes))
    floor = np.log10(names.tokens + names.kinds + 1)
    base = doc_sum(np.log10(count + 1.0) - floor) + np.log10(names.mass[-1] + 1.0) - floor
    known = doc_sum((count > 0).astype(float)).round().astype(np.int64) + (names.mass[-1] > 0)
    inside = doc_sum(names.word_share(cls, count))
    seq, full = _with_ends(cls, codes, sizes, names.end)
    chain = log_likelihood(model, seq, np.cumsum(full) - full, full) / np.log(10)
    return pa.table(
        {
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(full), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(full), names.tokens)), "base_score": pa.array(base), "score": pa.array(inside + chain),
        }
    )


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text; other columns are left alone).

    Null, empty and blank texts are the end token alone. Rows with a null doc_id are in training, as those of the other
    folds; repeated rows count as often as they stand. Words that tie for a class of their own are taken in the order of
    their hashes. Very long texts are scored whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = written(blocks(docs), "blocks")
    one = table.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("w")).first()
    parts = max(16, int(one["w"]) // 8 // _PART)
    answers = written(counted(table, parts), "answers")
    names = classes(vocabulary(answers), int(one["n"]))
    model, _ = trained(table, names)
    given = spark.sparkContext.broadcast((model, names))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right["part"].to_pylist(), right["counts"].to_pylist(), strict=True))
        out = [_NONE]
        for i in range(left.num_rows):
            row = left.slice(i, 1).to_pylist()[0]
            h = np.frombuffer(row["words"], U64)
            order, named, first = _parts_of(h, parts)
            count = np.zeros(len(h), dtype=np.int64)
            for p, a, b in zip(named.tolist(), first, [*first[1:], len(order)], strict=True):
                count[order[a:b]] = unpacked_counts(replies[p], b - a)
            out.append(block_scores(row, count, *given.value))
        return pa.concat_tables(out)

    rows = table.select("block", "doc_ids", "held", "sizes", "codes", "words", "suffixes")
    replies = answers.filter("block <> -1").select("block", "part", "counts")
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, _SCORES)


_NONE = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents."""
    return scored(documents(spark, sf_dir))
