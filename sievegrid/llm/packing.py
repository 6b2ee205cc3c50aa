"""Best-fit packing of documents into sequences of fixed capacity, by matching large items.

Lengths are integers up to the capacity, so the whole decision needs their histogram only: at most `capacity`
numbers, whatever the size of the corpus. Large pieces (over a third of the capacity; at most two fit into a
bin) are matched greedily, the longest with the longest that still fits. Smaller pieces then go, longest first,
to the bins with the tightest remaining gap. The plan is a list of runs: pieces of one length, numbered from r,
go to bins numbered from b. Spark numbers the pieces of each length and looks its run up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.shared import documents, running_totals, written
from sievegrid.llm.textbytes import slices, tidy
from sievegrid.llm.tokens import ENCODE_BYTES, END_ID, Encoder, tokenizer_path, with_end

CAPACITY = 1024


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first bin, bins, offset), and the number of bins.

    Piece `rank` of its length, in the run with the largest first rank up to it, goes to bin
    first bin + (rank - first rank) mod bins, at offset + length * ((rank - first rank) div bins).
    """
    left = {n: int(k) for n, k in histogram.items() if k > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    gaps: dict[int, list] = defaultdict(list)  # gap → groups (bins, [(length, pieces in each bin)])
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for x in large:
        while left[x]:
            fits = (y for y in large if y <= min(x, capacity - x) and left[y] >= 1 + (x == y))
            y = next(fits, None)
            if y is None:
                gaps[capacity - x].append((left[x], [(x, 1)]))
                left[x] = 0
            elif y == x:
                pairs = left[x] // 2
                gaps[capacity - 2 * x].append((pairs, [(x, 2)]))
                left[x] -= 2 * pairs
            else:
                pairs = min(left[x], left[y])
                gaps[capacity - x - y].append((pairs, [(x, 1), (y, 1)]))
                left[x] -= pairs
                left[y] -= pairs
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s and gaps[g]), default=None)
            if gap is None:
                gaps[capacity].append((-(-left[s] // (capacity // s)), []))
                continue
            bins, items = gaps[gap].pop()
            each = gap // s
            full, rest = min(bins, left[s] // each), 0
            if full < bins:
                rest = left[s] - full * each
            for n, k in ((full, each), (1 if rest else 0, rest), (bins - full - (1 if rest else 0), 0)):
                if n:
                    gaps[gap - k * s].append((n, [*items, (s, k)] if k else items))
            left[s] -= full * each + rest
    runs, used, first_bin = [], defaultdict(int), 0
    for gap in sorted(gaps):
        for bins, items in gaps[gap]:
            if not items:
                continue
            offset = 0
            for length, k in items:
                runs.append((length, used[length], first_bin, bins, offset))
                used[length] += bins * k
                offset += length * k
            first_bin += bins
    return runs, first_bin


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token ids with the end id (null text: the end id alone).

    Documents over the capacity are cut into pieces of that length, of which the first may be shorter.
    """
    tokenizer = tokenizer or tokenizer_path()

    def cut(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0)
            for a, b in slices(texts, ENCODE_BYTES):
                flat, off = with_end(*encoder.ids(texts.slice(a, b - a)), end)
                n = np.diff(off)
                count = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[of], capacity)
                at = off[:-1][of] + start
                crc = [zlib.crc32(flat[x:y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. Rows that repeat are packed as often as they stand; an empty table gives no rows."""
    table = written(pieces(docs, capacity, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan_bins(histogram, capacity)
    runs = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            k = rank - run[:, 1]
            columns = [*batch.columns[:5], pa.array(run[:, 2] + k % run[:, 3]), pa.array(run[:, 4] + length * (k // run[:, 3]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = running_totals(table, "length", ["doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, a row for each piece."""
    return pack(documents(spark, sf_dir))
