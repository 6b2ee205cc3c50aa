"""Quality rules: fixed limits on document statistics, and gradient-boosted trees over them.

A text gives counts (words, symbols, lines that repeat, words in windows that repeat) and shares made of them. Trees are
boosted on the logistic loss of a bounded labelled sample, from histograms of the shares. A split on a share of
CONSTRAINTS that would let more repetition or more symbols raise the score isn't made, and its two sides bound all leaves
below them, so the whole forest is monotonic in that share. The forest is flattened into node arrays, which tasks walk for
all texts of a slice and all trees at once.
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
from sievegrid.llm.textbytes import U64, mix64, packed, slices, span_hashes, tidy, words

#: Bounds of the model: labelled documents of either label that are read for it, trees, their depth, cells of a statistic.
EACH = 2000
TREES, DEPTH, CELLS = 60, 4, 64
RATE, RIDGE, LEAST_WEIGHT = 0.2, 1.0, 1.0
THRESHOLD = 0.3
#: The fixed limits: fewest words, and most words in a hundred that stand in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The statistics that the trees see.
STATISTICS = [
    "log_words", "word_length", "symbols_a_word", "dup_line_share", "repeat_word_share", "upper_share", "digit_share", "sign_share", "distinct_share",
    "same_neighbour_share", "words_a_line", "stopped_line_share", "bare_word_share", "top_word_share", "short_word_share", "non_ascii_share", "sign_end_share", "capital_share",
]
#: -1: more of it never raises the score; 1: never lowers it.
CONSTRAINTS = {"symbols_a_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "same_neighbour_share": -1, "top_word_share": -1, "bare_word_share": -1}


def _bytes(chosen) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) if isinstance(c, str) else c for c in chosen]] = True
    return table


_SYMBOL = _bytes("#*$%&|<>")
_UPPER, _LOWER, _DIGIT = _bytes(range(65, 91)), _bytes(range(97, 123)), _bytes(range(48, 58))
_SIGN = _bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_WIDE = _bytes(range(128, 256))
_FOLLOWS = _bytes(range(128, 192))  # later bytes of a code point
_STOP = _bytes(".!?")
_STEP = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=U64)


def _between(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of mask are true from a to before b, for each pair."""
    sums = np.zeros(len(mask) + 1, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=sums[1:])
    return (sums[b] - sums[a]).astype(np.int64)


def _times(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each hash how often it stands in its document."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    _, back, count = np.unique(hashes ^ mix64((of + 1).astype(U64) * U64(0xD1B54A32D192ED03)), return_inverse=True, return_counts=True)
    return count[back]


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS, STATISTICS) of each text, a row each; zeros for null and empty texts."""
    buf, off = packed(texts)
    n = len(off) - 1
    first_byte, last_byte = off[:-1], off[1:]
    starts, ends, at = words(buf, off)
    n_words = np.diff(at)
    of = np.repeat(np.arange(n), n_words)
    hashes = span_hashes(buf, starts, ends)

    def of_words(mask):
        return _between(mask, at[:-1], at[1:])

    def of_bytes(table):
        return _between(table[buf], first_byte, last_byte)

    # lines
    breaks = np.flatnonzero(buf == 10)
    line_first = np.unique(np.concatenate([first_byte[last_byte > first_byte], breaks + 1]))
    line_first = line_first[line_first < len(buf)]
    line_of = np.searchsorted(off, line_first, side="right") - 1
    following = np.searchsorted(breaks, line_first)
    line_end = np.minimum(np.append(breaks, len(buf))[following], off[line_of + 1])
    word_from, word_to = np.searchsorted(starts, line_first), np.searchsorted(starts, line_end)
    full = word_to > word_from
    line_first, line_end, line_of, word_to = line_first[full], line_end[full], line_of[full], word_to[full]
    n_lines = np.bincount(line_of, minlength=n)
    again = _times(span_hashes(buf, line_first, line_end), line_of)
    n_dup = n_lines - np.rint(np.bincount(line_of, weights=1.0 / np.maximum(again, 1), minlength=n)).astype(np.int64)

    # windows
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    whole = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= at[1:][of])
    if len(whole):
        joined = np.zeros(len(whole), dtype=U64)
        for k in range(WINDOW):
            joined += mix64(hashes[whole + k] * _STEP[k])
        twice = whole[_times(joined, of[whole]) > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    n_repeat = of_words(np.cumsum(covered[:-1]) > 0)

    n_points = _between(~_FOLLOWS[buf], starts, ends)
    word_chars = np.bincount(of, weights=n_points, minlength=n).astype(np.int64)
    counts = np.stack([n_words, word_chars, of_bytes(_SYMBOL), n_dup, n_repeat], axis=1)

    # shares
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    times = _times(hashes, of)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, of, times)
    distinct = np.bincount(of, weights=1.0 / np.maximum(times, 1), minlength=n)
    letter = _UPPER | _LOWER | _WIDE
    bare = _between(letter[buf] | _DIGIT[buf], starts, ends) == 0
    ends_in = buf[ends - 1] if len(ends) else buf[:0]
    begins = buf[starts] if len(starts) else buf[:0]
    stopped = _STOP[buf[ends[word_to - 1] - 1]] if len(word_to) else np.zeros(0, bool)
    upper, lower, size = of_bytes(_UPPER), of_bytes(_LOWER), np.maximum(last_byte - first_byte, 1)
    w = np.maximum(n_words, 1)
    shares = [
        np.log1p(n_words), word_chars / w, counts[:, 2] / w, n_dup / np.maximum(n_lines, 1), n_repeat / w, upper / np.maximum(upper + lower, 1), of_bytes(_DIGIT) / size,
        of_bytes(_SIGN) / size, distinct / w, of_words(same) / w, n_words / np.maximum(n_lines, 1), np.bincount(line_of, weights=stopped, minlength=n) / np.maximum(n_lines, 1),
        of_words(bare) / w, top / w, of_words(n_points <= 3) / w, of_bytes(_WIDE) / size, of_words(_SIGN[ends_in]) / w, of_words(_UPPER[begins]) / w,
    ]
    return counts, np.stack(shares, axis=1).astype(np.float32)


def failed(counts: np.ndarray) -> np.ndarray:
    """Texts that break a fixed limit."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(self.roots):
            for a in range(0, len(x), 2048):
                part = x[a : a + 2048]
                node, row = np.tile(self.roots, (len(part), 1)), np.arange(len(part))[:, None]
                for _ in range(DEPTH):
                    node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                out[a : a + 2048] += self.value[node].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Likelihood of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, low: float, high: float, signs: np.ndarray):
    """(gain, feature, cell, left value, right value) of the best split of a node from its histograms (features x cells), or None."""

    def value(s, t):
        return np.clip(-s / (t + RIDGE), low, high)

    def worth(s, t, v):
        return -(s * v + 0.5 * (t + RIDGE) * v * v)

    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gt, ht = g[0].sum(), h[0].sum()
    gr, hr = gt - gl, ht - hl
    vl, vr = value(gl, hl), value(gr, hr)
    gain = worth(gl, hl, vl) + worth(gr, hr, vr) - worth(gt, ht, value(gt, ht))
    gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT) | (signs[:, None] * (vr - vl) < 0)] = -np.inf
    f, c = np.unravel_index(np.argmax(gain), gain.shape)
    return (gain[f, c], f, c, vl[f, c], vr[f, c]) if gain[f, c] > 1e-6 else None


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boost trees on (rows of STATISTICS, labels 0 and 1). Rows of one label only, or none, give no trees and a score of 1."""
    signs = np.array([CONSTRAINTS.get(s, 0) for s in STATISTICS])
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(v: float) -> int:
        k = len(feature)
        for column, item in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, v)):
            column.append(item)
        return k

    mean = float(y.mean()) if len(y) else 1.0
    if not 0 < mean < 1:
        return Forest(*(np.zeros(0, t) for t in (np.int64, np.float32, np.int64, np.int64, np.float64, np.int64)), base=30.0)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CELLS + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    cell = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # cell c: at most edge c
    flat = cell + np.arange(x.shape[1]) * CELLS
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root = add(0.0)
        roots.append(root)
        open_ = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for _ in range(DEPTH):
            deeper = []
            for node, rows, low, high in open_:
                k, many = flat[rows].ravel(), x.shape[1]
                hist_g = np.bincount(k, weights=np.repeat(g[rows], many), minlength=many * CELLS).reshape(many, CELLS)
                hist_h = np.bincount(k, weights=np.repeat(h[rows], many), minlength=many * CELLS).reshape(many, CELLS)
                if (best := _split(hist_g, hist_h, low, high, signs)) is None:
                    continue
                _, f, c, vl, vr = best
                feature[node], threshold[node], left[node], right[node] = f, edges[f][c], add(RATE * vl), add(RATE * vr)
                down, middle = cell[rows, f] <= c, (vl + vr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
                deeper += [(left[node], rows[down], *bounds[0]), (right[node], rows[~down], *bounds[1])]
            open_ = deeper
        tree = Forest(np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value), np.array([root]), 0.0)
        margin = margin + tree.margins(x)
    return Forest(np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value), np.array(roots), base)


def trained(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Forest:
    """The forest of at most 2 * each labelled documents, fitted on `quality`."""

    def rows(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                _, x = statistics(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).slice(a, b - a)], names=["doc_id", "x", "label"])

    few = sample(docs, labels, "quality", each).mapInArrow(tidy(rows), "doc_id long, x binary, label int").collect()  # 2 * each rows of fixed size
    few = sorted(few, key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in few]).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["label"] for r in few], dtype=np.float64))


def judged(docs: DataFrame, labels: DataFrame, each: int = EACH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, COUNTS, base_failed, score, kept of every row of docs (doc_id, text; other columns are left alone).

    kept: no fixed limit is broken and the forest's score reaches the threshold. Without usable labels of both kinds the
    limits decide alone (score 1). Null, empty and blank texts have no words and fail. Rows that repeat or lack a doc_id are
    judged each by itself; held_out is false without one. Ties don't occur: the same text has the same verdict. Very long
    texts are read whole. An empty table gives no rows.
    """
    forest = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, each))

    def judge(batches):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                counts, x = statistics(batch.column(2).slice(a, b - a))
                score, bad = forest.value.scores(x), failed(counts)
                own = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(c) for c in counts.T), pa.array(bad), pa.array(score), pa.array(~bad & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "held_out", *COUNTS, "base_failed", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(judge), f"doc_id long, held_out boolean, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")


def filtered(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that break no limit and that the forest finds good, as they are."""
    given = docs.sparkSession.sparkContext.broadcast(forest)

    def keep(texts):
        counts, x = statistics(texts)
        return ~failed(counts) & (given.value.scores(x) >= threshold)

    return kept_rows(docs, keep)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
