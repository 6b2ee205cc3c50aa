"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed byte trigrams, trigrams of byte kinds (case, digit, blank, sign) and the repetition of
neighbouring words. A truncated singular value decomposition of the term weights of a bounded labelled sample
gives the latent space; the sample's vectors are broadcast. Every document takes exact cosines with all of them,
in blocks, and its nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.labelled import held_out, sample
from sievegrid.llm.shared import documents
from sievegrid.llm.shared import filtered as kept_rows
from sievegrid.llm.textbytes import SLICE_BYTES, packed, slices, span_hashes, tidy, words

#: Bounds of the model: labelled documents of either label that are read for it, size of the latent space, voters.
EACH = 2000
LATENT = 48
NEIGHBOURS = 25
SHARPNESS = 24.0
THRESHOLD = 0.3
#: Texts whose terms are held at once.
_ROWS = 256

_TRIGRAMS, _KINDS = 2048, 8
_KIND = np.full(256, 6, dtype=np.int32)
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[0x20] = 3
_KIND[9:14] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_KIND[128:256] = 7
DIMENSIONS = _TRIGRAMS + _KINDS**3 + 4


def terms(texts: pa.Array) -> np.ndarray:
    """A row of term weights for each text; square roots of relative frequencies, so that long texts weigh as much as short ones. Empty texts have zeros."""
    buf, off = packed(texts)
    n, out = len(off) - 1, np.zeros((len(off) - 1, DIMENSIONS), dtype=np.float32)
    if len(buf) < 3:
        return out
    at = _TRIGRAMS + _KINDS**3
    for a in range(0, len(buf) - 2, SLICE_BYTES):  # a very long text in pieces
        part = buf[a : a + SLICE_BYTES + 2]
        of = np.searchsorted(off, np.arange(a, a + len(part)), side="right") - 1
        same = of[2:] == of[:-2]
        row = of[2:][same]
        b = part.astype(np.uint32)
        gram = ((b[:-2] * np.uint32(961) + b[1:-1] * np.uint32(31) + b[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        kind = _KIND[part]
        shape = kind[:-2] * (_KINDS * _KINDS) + kind[1:-1] * _KINDS + kind[2:]
        out[:, :_TRIGRAMS] += np.bincount(row * _TRIGRAMS + gram[same], minlength=n * _TRIGRAMS).reshape(n, -1)
        out[:, _TRIGRAMS:at] += np.bincount(row * _KINDS**3 + shape[same], minlength=n * _KINDS**3).reshape(n, -1)
    starts, ends, first = words(buf, off)
    h = span_hashes(buf, starts, ends)
    where = np.repeat(np.arange(n), np.diff(first))
    total = np.maximum(np.diff(first), 1)
    for k in (1, 2):
        again = (h[k:] == h[:-k]) & (where[k:] == where[:-k])
        share = np.bincount(where[k:][again], minlength=n) / total
        out[:, at + 2 * k - 2], out[:, at + 2 * k - 1] = share, np.where(np.diff(first) > 0, 1 - share, 0)
    size = np.maximum(np.diff(off) - 2, 1)[:, None]
    out[:, :at] /= size
    out[:, :_TRIGRAMS] *= 0.5
    return np.sqrt(out, out=out)


@dataclass
class Voters:
    """The fitted space and the labelled vectors in it."""

    weight: np.ndarray  # of the terms
    basis: np.ndarray  # DIMENSIONS x latent
    vectors: np.ndarray  # unit rows
    labels: np.ndarray

    def vectors_of(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; 0 for texts without terms."""
        out = np.zeros(len(x))
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(x), 512):
            cosine = self.vectors_of(x[a : a + 512]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
            out[a : a + 512] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        out[~x.any(axis=1)] = 0.0
        return out


def fit(rows: list[tuple[np.ndarray, int]], latent: int = LATENT) -> Voters:
    """From (term weights, label) of the sample, by a randomised decomposition with a fixed seed."""
    if not rows:
        return Voters(np.ones(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x, y = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    a = x * weight
    rng = np.random.default_rng(1)
    q = a @ rng.standard_normal((a.shape[1], latent + 16)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(a @ (a.T @ q))
    _, _, basis = np.linalg.svd(q.T @ a, full_matrices=False)
    model = Voters(weight, np.ascontiguousarray(basis[:latent].T), np.zeros((0, 1)), y)
    model.vectors = model.vectors_of(x).astype(np.float32)
    return model


def trained(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Voters:
    """The model of at most 2 * each labelled documents."""

    def rows(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), rows=_ROWS):
                x = terms(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), batch.column(2).slice(a, b - a)], names=["doc_id", "x", "label"])

    few = sample(docs, labels, "quality", each).mapInArrow(tidy(rows), "doc_id long, x binary, label int").collect()  # 2 * each rows of fixed size
    few = sorted(few, key=lambda r: r["doc_id"])
    return fit([(np.frombuffer(r["x"], dtype=np.float16).astype(np.float32), r["label"]) for r in few])


def scored(docs: DataFrame, labels: DataFrame, each: int = EACH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text; other columns are left alone).

    Null and empty texts score 0; without any usable label all do. Rows that repeat are scored as often as they stand, and
    rows without a doc_id too; held_out is false for them. Neighbours that tie at the last place count as numpy orders them, the
    same on every run. Very long texts are read whole, piece by piece. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, each))

    def score(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(texts, rows=_ROWS):
                s = model.value.scores(terms(texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(score), "doc_id long, held_out boolean, score double, predicted int")


def filtered(docs: DataFrame, model: Voters, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the voters find good, as they are; all of them where nobody votes."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: given.value.scores(terms(texts)) >= (threshold if len(given.value.labels) else 0.0), _ROWS)


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
