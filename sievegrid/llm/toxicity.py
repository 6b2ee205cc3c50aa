"""Toxicity by a counterfactual-regularised logistic model.

Features are the presence of letter words and of their first 4, 5 and 6 bytes, so that inflected forms of a stem
count. Those that separate the labels significantly on a bounded labelled sample become the vocabulary. Sample texts
that mention an identity term are copied once for each other member of the term's group in the text's language, and the fit
penalises the squared difference of the scores of text and copy: neutral mentions of a group then carry no weight.
The language is read from a text's own function words.
"""

from __future__ import annotations

import collections
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.labelled import held_out, sample
from sievegrid.llm.shared import documents
from sievegrid.llm.shared import filtered as kept_rows
from sievegrid.llm.textbytes import LOWER, U64, mix64, packed, slices, span_hashes, tidy

#: Bound of the model: labelled documents of either label that are read for it.
EACH = 3000
#: A feature counts whose shares among the labels differ by so many standard errors.
LEAST_Z = 5.0
RIDGE = 0.00004
SWAP_PENALTY = 4.0
THRESHOLD = 0.5

#: Terms of one group are exchanged for each other, by language; lower case.
IDENTITY_GROUPS: dict[str, tuple[tuple[str, ...], ...]] = {
    "en": (
        ("he", "she", "they"), ("his", "her", "their"), ("man", "woman", "person"), ("men", "women", "people"), ("boy", "girl", "child"),
        ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "african", "european"),
        ("gay", "lesbian", "straight", "bisexual", "transgender"), ("young", "old", "elderly"), ("deaf", "blind", "disabled"),
        ("american", "mexican", "chinese", "german", "french", "spanish"), ("immigrant", "native", "refugee"),
    ),
    "de": (("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"), ("christ", "muslim", "jude"), ("christen", "muslime", "juden")),
    "fr": (("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("chrétien", "musulman", "juif")),
    "es": (("hombre", "mujer"), ("hombres", "mujeres"), ("chico", "chica"), ("cristiano", "musulmán", "judío")),
}
#: Function words that tell the language; of a tie the first counts.
MARKS = {"en": ("the", "and", "of", "is", "a"), "de": ("der", "die", "und", "ist", "ein"), "fr": ("le", "la", "les", "et", "est"), "es": ("el", "los", "y", "es", "que")}

_PREFIXES = (4, 5, 6)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIEVE_BITS = 20


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit feature) of all words and prefixes, repeats included."""
    buf, off = packed(texts)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    buf = LOWER[buf]
    inside = _LETTER[buf]
    first = np.zeros(len(buf), dtype=bool)
    first[off[:-1][off[1:] > off[:-1]]] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first
    after = np.concatenate([inside[1:] & ~first[1:], [False]])
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(off, starts, side="right") - 1
    rows, found = [row], [span_hashes(buf, starts, ends)]
    for n in _PREFIXES:
        long = ends - starts >= n
        rows.append(row[long])
        found.append(mix64(span_hashes(buf, starts[long], starts[long] + n) ^ U64(n)))
    return np.concatenate(rows), np.concatenate(found)


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    row, f = features(texts)
    order = np.lexsort((f, row))
    row, f = row[order], f[order]
    new = np.ones(len(f), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (f[1:] != f[:-1])
    return row[new], f[new]


_SWAPS = {language: {t: [*g[k + 1 :], *g[:k]] for g in groups for k, t in enumerate(g)} for language, groups in IDENTITY_GROUPS.items()}
_IDENTITY = {language: re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(map(re.escape, terms), key=len, reverse=True)) + r")(?![^\W\d_])", re.IGNORECASE) for language, terms in _SWAPS.items()}


def language_of(text: str) -> str:
    found = collections.Counter(text.lower().split())
    return max(MARKS, key=lambda language: sum(found[w] for w in MARKS[language]))


def swapped(text: str) -> list[str]:
    """The copies of a text: in copy k every identity term is exchanged for the one k + 1 places on in its group, until each member had its turn."""
    language = language_of(text)
    others = _SWAPS[language]
    found = {m[0].lower() for m in _IDENTITY[language].finditer(text)}
    return [_IDENTITY[language].sub(lambda m: others[m[0].lower()][turn % len(others[m[0].lower()])], text) for turn in range(max((len(others[t]) for t in found), default=0))]  # noqa: B023


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted features
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        self.sieve[(self.vocabulary & U64((1 << _SIEVE_BITS) - 1)).astype(np.int64)] = True

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in the vocabulary), each once."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, f = features(texts)
        some = self.sieve[(f & U64((1 << _SIEVE_BITS) - 1)).astype(np.int64)]
        row, f = row[some], f[some]
        at = np.searchsorted(self.vocabulary, f)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == f
        both = np.unique(row[known] * len(self.vocabulary) + at[known])
        return both // len(self.vocabulary), both % len(self.vocabulary)

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, at = self.hits(texts)
        z = self.bias + np.bincount(row, weights=self.weights[at], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Sparse:
    """A matrix of few entries."""

    rows: int
    columns: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, lists: list[tuple[list[int], list[float]]], columns: int) -> Sparse:
        """A row for each (columns, values)."""
        row = np.repeat(np.arange(len(lists)), [len(c) for c, _ in lists])
        flat = lambda k, kind: np.array([x for entry in lists for x in entry[k]], dtype=kind)
        return cls(len(lists), columns, row, flat(0, np.int64), flat(1, np.float64))

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * v[self.column], minlength=self.rows)

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * u[self.row], minlength=self.columns)


def _solved(times, gradient: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """x with times(x) = gradient, by conjugate gradients scaled by the diagonal."""
    x, r = np.zeros_like(gradient), gradient.copy()
    z = r / scale
    p, size = z.copy(), r @ z
    for _ in range(400):
        if size <= 1e-20:
            break
        q = times(p)
        step = size / (p @ q)
        x, r = x + step * p, r - step * q
        z = r / scale
        p, size = z + (r @ z) / size * p, r @ z
    return x


def fit(x: Sparse, y: np.ndarray, d: Sparse, ridge: float = RIDGE, penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method: mean log loss (labels weigh alike) + ridge |w|² + penalty · mean (d·w)², d being text minus swapped copy."""
    m = x.columns
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, fixed = np.zeros(m + 1), np.append(np.full(m, 2 * ridge), 1e-9)
    tie = 2 * penalty / max(1, d.rows)

    def held(v: np.ndarray) -> np.ndarray:
        out = fixed * v
        out[:m] += tie * d.back(d.dot(v[:m]))
        return out

    squares = np.append(tie * np.bincount(d.column, weights=d.value**2, minlength=m), 0.0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w[:m]) + w[m], -40, 40)))
        u, bend = share * (p - y), share * np.maximum(p * (1 - p), 1e-6)

        def times(v: np.ndarray, bend=bend) -> np.ndarray:
            b = bend * (x.dot(v[:m]) + v[m])
            return held(v) + np.append(x.back(b), b.sum())

        scale = fixed + squares + np.append(np.bincount(x.column, weights=bend[x.row] * x.value**2, minlength=m), bend.sum())
        step = _solved(times, np.append(x.back(u), u.sum()) + held(w), scale)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:m], float(w[m])


def trained(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Model:
    """The model of at most 2 * each labelled documents; of one label only, or none, all scores are 0 (to 17 digits).

    A doc_id that repeats counts once. Features tie freely: all that pass LEAST_Z are in.
    """
    few = sample(docs, labels, "toxic", each).persist()

    def listed(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                row, f = distinct_features(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), batch.column(2).slice(a, b - a).take(pa.array(row))], names=["f", "label"])

    total = {r["label"]: r["n"] for r in few.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = total.get(1, 0), total.get(0, 0)
    if not ones or not zeros:
        few.unpersist()
        return Model(np.zeros(0, U64), np.zeros(0), -40.0)
    df = few.mapInArrow(listed, "f long, label int").groupBy("f").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    share = (F.col("p") + F.col("q")) / (ones + zeros)
    z = (F.col("p") / ones - F.col("q") / zeros) / F.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    best = df.withColumn("z", F.abs(z)).filter(F.col("z") >= LEAST_Z).collect()  # words of the bounded sample
    names = {r["f"] for r in best}
    model = Model(np.array(sorted(f % (1 << 64) for f in names), dtype=U64), np.zeros(len(names)), 0.0)

    def rows(batches):
        for batch in batches:
            out = []
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                others = swapped(text)
                row, at = model.hits(pa.array([text, *others]))
                out.append({"label": label, "hits": at[row == 0].tolist(), "swaps": [at[row == k + 1].tolist() for k in range(len(others))]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("label", pa.int32()), ("hits", pa.list_(pa.int64())), ("swaps", pa.list_(pa.list_(pa.int64())))]))

    got = few.mapInArrow(rows, "label int, hits array<long>, swaps array<array<long>>").collect()  # 2 * each rows, of vocabulary places
    few.unpersist()
    got.sort(key=lambda r: (r["label"], r["hits"]))

    m = len(model.vocabulary)
    x, y = Sparse.of([(r["hits"], [1.0] * len(r["hits"])) for r in got], m), np.array([r["label"] for r in got], dtype=float)
    differ = []
    for r in got:
        for other in r["swaps"]:
            gone, new = sorted(set(r["hits"]) - set(other)), sorted(set(other) - set(r["hits"]))
            share = len(r["swaps"]) ** -0.5  # the copies of a text weigh as much as one
            differ.append((gone + new, [share] * len(gone) + [-share] * len(new)))
    return Model(model.vocabulary, *fit(x, y, Sparse.of(differ, m)))


def scored(docs: DataFrame, labels: DataFrame, each: int = EACH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text; other columns are left alone).

    Null and empty texts have the score of no word at all. Rows that repeat are scored as often as they stand, and rows
    without a doc_id too; held_out is false for them. Very long texts are read whole. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, each))

    def score(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(texts):
                s = model.value.scores(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(score), "doc_id long, held_out boolean, score double, predicted int")


def filtered(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model does not find toxic, as they are."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: given.value.scores(texts) < threshold)


def op4_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
