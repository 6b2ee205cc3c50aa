"""Mixing sources to target weights.

The words of a source, document after document in an order that doc_id and text decide, form fixed-length blocks. The mix is a row of output shards with
slots. A multinomial draw gives every shard its source counts, and all slots of a source to some shard.
A source's slots are numbered through; slot j is block p(j mod n) of its n blocks, p being a pseudorandom
permutation of the indices that is drawn anew for each pass. Slots and blocks then meet in a join on the index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.shared import documents, running_totals, written
from sievegrid.llm.textbytes import mix64, packed, slices, tidy, words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2.0
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 24
LEAST_SHARDS = 8
SEED = 20_11
#: Sources are names that carry a weight each; their table is held by the driver.
MOST_SOURCES = 100_000

_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """What each source is to give: `share` of all sizes by weight, at most `most` times its size; the excess goes to the others by weight."""
    total, fixed = share * sum(sizes), {}
    while True:
        rest = [k for k in range(len(sizes)) if k not in fixed]
        weight = sum(weights[k] for k in rest)
        free = total - sum(fixed.values())
        goal = {k: free * weights[k] / weight for k in rest} if weight else {}
        over = {k: most * sizes[k] for k in rest if goal[k] > most * sizes[k]}
        if not over:
            return [fixed[k] if k in fixed else goal[k] for k in range(len(sizes))]
        fixed |= over


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a Feistel network over the next power of four, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15) % (1 << 64)))
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the shard, slots of each source in the shards before it).

    All shards together draw each source's slots from a multinomial of equal shares, so all slots are given out. The draw goes
    down a tree of shard ranges: each node splits its slots by a binomial seeded with the node, so a shard finds its
    own counts alone, and nothing grows with the number of shards.
    """
    counts, before, a, b = np.asarray(slots, dtype=np.int64), np.zeros(len(slots), dtype=np.int64), 0, shards
    while b - a > 1:
        middle = (a + b) // 2
        left = np.random.default_rng([seed, a, b]).binomial(counts, (middle - a) / (b - a))
        if shard < middle:
            counts, b = left, middle
        else:
            counts, before, a = counts - left, before + left, middle
    return counts, before


def _plan(sized: DataFrame, block_words: int) -> list[dict]:
    """A row for each source in order: its name, size, target, blocks and slots."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([r["size"] for r in rows], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(rows))])
    plan = []
    for k, (r, goal) in enumerate(zip(rows, goals, strict=True)):
        blocks = -(-r["size"] // block_words)
        slots = min(int(MOST_REPEATS) * blocks, round(goal * blocks / r["size"])) if r["size"] else 0
        plan.append({"k": k, "source": r["source"], "source_size": r["size"], "target": float(goal), "blocks": blocks, "slots": slots})
    return plan


def slot_table(spark: SparkSession, plan: list[dict], block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """shard, slot (its number in the source), k (the source's number), block: one row for each slot of the mix."""
    slots, blocks = np.array([p["slots"] for p in plan], dtype=np.int64), [p["blocks"] for p in plan]  # a number for each source
    shards = max(LEAST_SHARDS, -(-int(slots.sum()) * block_words // shard_words))

    def fill(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, first = shard_counts(slots, shards, shard, seed)
                for k in np.flatnonzero(counts).tolist():
                    j = first[k] + np.arange(counts[k])
                    turn, index = j // blocks[k], j % blocks[k]
                    block = np.empty_like(j)
                    for t in np.unique(turn).tolist():
                        block[turn == t] = permuted(index[turn == t], blocks[k], seed + 1_000_003 * k + t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard)), pa.array(j), pa.array(np.full(len(j), k, dtype=np.int32)), pa.array(block)], names=["shard", "slot", "k", "block"])

    return spark.range(0, shards, 1, min(shards, 4096)).mapInArrow(fill, "shard long, slot long, k int, block long")


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target; passages taken).

    A passage row tells which words of which document row (`row`) a slot's block takes: from_word, to_word, times.
    Null or blank texts have size 0 and give nothing; a null source is one source, the last. Rows that repeat are rows of
    their own, and null doc_ids count like others. An empty table gives no rows. `keep`: columns to carry along.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    place = [F.xxhash64("doc_id", "text").alias("_place"), F.xxhash64("text").alias("_text")]  # rows that tie here are alike
    sized = written(docs.select(*(keep or ["doc_id"]), F.col("source").cast("string").alias("source"), size.alias("size"), *place).withColumn("row", F.monotonically_increasing_id()), "sized")
    plan = _plan(sized, block_words)
    named = spark.createDataFrame([(p["k"], p["source"], p["source_size"], p["target"]) for p in plan], "k int, source string, source_size long, target double")
    named = F.broadcast(named) if len(plan) <= 10_000 else named
    sized = sized.withColumnRenamed("source", "_source").join(named, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    placed = running_totals(sized.filter("size > 0").select("row", "k", "size", "_place", "_text"), "k", ["_place", "_text"], F.col("size"), "start")
    sized = sized.drop("_place", "_text")
    block = F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block")
    parts = placed.select("row", "k", "start", "size", block).select(
        "row", "k", "block",
        F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")).alias("from_word"),
        F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start")).alias("to_word"),
    )
    times = slot_table(spark, plan, block_words).groupBy("k", "block").agg(F.count("*").alias("times"))
    # the slots grow with the corpus, though they come from a short range of shards: without the hint Spark takes them for small
    return sized, parts.join(times.hint("merge"), ["k", "block"]).select("row", "from_word", "to_word", "times")


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    sized, passages = mixed(documents(spark, sf_dir))
    taken = passages.groupBy("row").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"))
    return sized.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents, in the columns of `docs`: of each document the words that were taken, and once more those taken twice.

    Gaps between taken passages close; n_chars is counted anew; documents of which nothing was taken are not in the mix.
    """
    schema, names = docs.schema, docs.columns
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_doc"), "doc_id", "source", "text")  # a struct, as its names may be those of the mix
    sized, passages = mixed(carried, block_words, keep=["_doc"])
    takes = passages.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word", "times"))).alias("takes"))  # as many as the document has blocks
    rows = sized.join(takes, "row").select("_doc", "takes")

    def cut(batches):
        for whole in batches:
            doc = whole.column(0)
            table = pa.RecordBatch.from_arrays([doc.field(k) for k in range(len(names))], names=names)
            for a, b in slices(table.column(names.index("text"))):
                yield cut_rows(table.slice(a, b - a), whole.column(1).slice(a, b - a))

    def cut_rows(table: pa.RecordBatch, takes: pa.Array) -> pa.RecordBatch:
        texts, of = [], []
        for i, take in enumerate(takes.to_pylist()):
            buf, off = packed(table.column(names.index("text")).slice(i, 1))
            starts = np.append(words(buf, off)[0], len(buf))
            for turn in range(1, max(t["times"] for t in take) + 1):
                parts = b"".join(buf[starts[t["from_word"]] : starts[t["to_word"]]].tobytes() for t in take if t["times"] >= turn)
                texts.append(parts.decode())
                of.append(i)
        out = table.take(pa.array(of, pa.int64()))
        out = out.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in names:
            out = out.set_column(names.index("n_chars"), "n_chars", pa.array([len(t) for t in texts]).cast(out.schema.field("n_chars").type))
        return out

    return rows.mapInArrow(tidy(cut), schema)
