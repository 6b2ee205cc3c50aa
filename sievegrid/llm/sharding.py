"""Sharding by balanced label propagation.

Documents of equal text are linked. Every linked document starts in the shard its id and text hash to; then, in rounds,
documents move to the shard that holds most of their group, weighed against how full shards are, as far as the
target's capacity quota allows. Copies are alike, so a group's state is how many of its copies each shard holds:
the rounds join and count such cells, never pairs of copies. Documents without links fill what is left: the few
heavy ones go to the emptiest shard one by one, the others by running totals cut at the remaining room.

Law `bytes`: shard sizes are near equal, and a group is split only where a shard's capacity forces it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.shared import HOT, documents, dropped, joined, running_totals, written

SHARDS = 8
ROUNDS = 4
#: A document over a shard's capacity / HEAVY is placed by itself; there are at most SHARDS * HEAVY of them.
HEAVY = 512
FULLNESS = 0.25


def _case(column: str, values: list[float]):
    """The value of the shard in the column."""
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col(column) + 1)


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["b"] for r in cells.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect()}
    return [int(found.get(k, 0)) for k in range(shards)]


def _accepted(moves: DataFrame, room: list[int]) -> DataFrame:
    """Column `yes`: how many of the n copies may move, the largest groups first, so that no target takes more than its room."""
    rank = F.least(F.floor(F.log2(F.col("n") * F.col("size"))), F.lit(60))
    ranked = moves.withColumn("turn", 60 - rank)
    before = running_totals(ranked, "target", ["g", "shard"], F.col("n") * F.col("size"), "before", bucket=F.col("turn") * 16 + F.pmod(F.xxhash64("g", "shard"), F.lit(16)))
    fits = F.floor((_case("target", room) - F.col("before")) / F.col("size"))
    return before.withColumn("yes", F.greatest(F.lit(0), F.least(F.col("n"), fits)).cast("long"))


def propagated(cells: DataFrame, capacity: float, shards: int, rounds: int) -> DataFrame:
    """The cells (g, shard, n copies, size of one) after the rounds; shard -1 holds copies that no shard had room for."""
    for _ in range(rounds):
        loads = _loads(cells, shards)
        full = [b / capacity for b in loads]
        total = cells.groupBy("g").agg(F.sum("n").alias("all"))
        score = F.col("n") / F.col("all") + FULLNESS * (1 - _case("shard", full))
        best = cells.join(total, "g").groupBy("g").agg(F.max(F.struct(score.alias("score"), (-F.col("shard")).alias("shard"))).alias("best")).select("g", (-F.col("best.shard")).cast("int").alias("target"))
        moves = cells.join(best, "g").filter("shard != target")
        moves = written(_accepted(moves, [max(0, int(capacity - b)) for b in loads]).select("g", "shard", "target", "size", "yes").filter("yes > 0"), "moves")
        if moves.isEmpty():
            dropped(moves)
            break
        out = moves.select("g", "shard", (-F.col("yes")).alias("n"), "size").union(moves.select("g", F.col("target").alias("shard"), F.col("yes").alias("n"), "size"))
        old, cells = cells, written(cells.select("g", "shard", "n", "size").union(out).groupBy("g", "shard").agg(F.sum("n").alias("n"), F.max("size").alias("size")).filter("n > 0"), "cells")
        dropped(old, moves)
    loads = _loads(cells, shards)
    if max(loads) <= capacity:
        return cells
    stay = _accepted(cells.withColumn("target", F.col("shard")), [int(capacity)] * shards)
    kept = stay.filter("yes > 0").select("g", "shard", F.col("yes").alias("n"), "size")
    left = stay.filter("yes < n").groupBy("g").agg(F.lit(-1).alias("shard"), F.sum(F.col("n") - F.col("yes")).alias("n"), F.max("size").alias("size"))
    return written(kept.union(left), "cells")


def _filled(free: DataFrame, loads: list[int], capacity: float) -> DataFrame:
    """row, shard of the free documents (row, size, place, g)."""
    spark = free.sparkSession
    heavy = free.filter(F.col("size") > capacity / HEAVY).select("row", "size", "place", "g").collect()  # at most SHARDS * HEAVY rows
    heap = [(b, k) for k, b in enumerate(loads)]
    heapq.heapify(heap)
    placed = []
    for r in sorted(heavy, key=lambda r: (-r["size"], r["place"], r["g"], r["row"])):
        b, k = heapq.heappop(heap)
        placed.append((r["row"], k))
        heapq.heappush(heap, (b + r["size"], k))
    now = {k: b for b, k in heap}
    light = free.filter(F.col("size") <= capacity / HEAVY)
    total = light.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    level = _level(list(now.values()), total)
    room, cut, cuts = [max(0.0, level - now[k]) for k in sorted(now)], 0.0, []
    for r in room:
        cut += r
        cuts.append(cut)
    light = running_totals(light.select("row", "size", "place", "g", F.lit(0).alias("one")), "one", ["place", "g"], F.col("size"), "before")
    shard = F.lit(len(room) - 1)
    for k in reversed(range(len(room) - 1)):
        shard = F.when(F.col("before") + F.col("size") / 2 < cuts[k], k).otherwise(shard)
    out = light.select("row", shard.cast("int").alias("shard"))
    return out.union(spark.createDataFrame(placed, "row long, shard int")) if placed else out


def _level(loads: list[int], more: int) -> float:
    """The height to which `more` fills the lowest loads."""
    loads = sorted(loads)
    for k in range(1, len(loads) + 1):
        level = (sum(loads[:k]) + more) / k
        if k == len(loads) or level <= loads[k]:
            return level
    return 0.0


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text).

    size is the UTF-8 bytes plus 1; a null text counts as no bytes and is linked with empty ones. Rows that repeat are
    documents of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # the order that decides: by id and text; rows that tie are alike, and those without an id are told apart by their number
    rows = written(rows.withColumn("place", F.xxhash64("g", F.coalesce("doc_id", "row"))), "rows")
    one = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    capacity, n = (one["b"] or 0) / shards, one["n"]
    if not capacity:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    first = rows.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    cells = first.groupBy("g", "shard").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    groups = written(cells.groupBy("g").agg(F.sum("n").alias("all"), F.count("*").alias("cells")).filter("all > 1").select("g", "all"), "groups")
    cells = propagated(written(cells.join(groups.select("g"), "g"), "cells"), capacity, shards, rounds)
    single = cells.groupBy("g").agg(F.count("*").alias("places"), F.max("shard").alias("shard"), F.sum("n").alias("all"))
    plan = written(single, "places")
    kept = rows.select("row", "size", "g", "place")
    whole = joined(kept, plan.filter("places = 1 and shard >= 0").select("g", "shard", "all"), "g", "all", n).select("row", "size", "shard")
    # groups in several shards: copies are numbered, and the cells take ranges of the numbers; a cell begins a range
    split = joined(kept, plan.filter("places > 1 or shard < 0").select("g", "all"), "g", "all", n)
    split = running_totals(split, "g", ["place", "row"], F.lit(1), "number")
    ranges = running_totals(cells, "g", ["shard"], F.col("n"), "from", buckets=1).select("g", "shard", "from", (F.col("from") + F.col("n")).alias("to"))
    ends = ranges.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("to", "shard"))).alias("ends"), F.max("to").alias("all"))  # at most a cell for each shard
    split = joined(split.select("row", "size", "g", "number"), ends, "g", "all", n)
    split = split.select("row", "size", F.filter("ends", lambda e: F.col("number") < e["to"])[0]["shard"].alias("shard"))
    linked = written(whole.union(split), "linked")
    lost = linked.filter("shard < 0").select("row").join(rows.select("row", "size", "place", "g"), "row").select("row", "size", "place", "g")
    single_rows = joined_out(rows.select("row", "size", "place", "g"), groups, n)
    linked = linked.filter("shard >= 0")
    loads = {r["shard"]: r["b"] for r in linked.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    filled = _filled(written(single_rows.union(lost), "free"), [int(loads.get(k, 0)) for k in range(shards)], capacity)
    placed = written(linked.select("row", "shard").union(filled), "placed")
    out = rows.select("row", "doc_id", "size", "text_crc32", "place", "g").join(placed, "row")
    out = running_totals(out, "shard", ["place", "g"], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def joined_out(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """The rows of no group; hot groups are left out before the shuffle."""
    hot = groups.filter(F.col("all") > total // HOT).select("g")
    return rows.join(F.broadcast(hot), "g", "left_anti").join(groups.select("g"), "g", "left_anti").select(rows.columns)  # at most HOT keys


def op8_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return sharded(documents(spark, sf_dir))
