"""Exact top-k search by a vector-approximation file.

Every component of a vector falls into one of 256 cells of its dimension; the cells, a byte each, are the
approximation. A query block scans them all for bounds of the inner product: no vector outside the kept ones can
reach the k-th best, as k others have larger lower bounds. Vectors that stand under the query's own vec_id alone are left out
of the scan, however many there are, so each of those k gives a row. Exact vectors are then read best bound first: those
with the k best bounds give a k-th score, and only vectors whose bound reaches it are read after them.

The edges of the cells are quantiles of a bounded sample, and the end cells reach to the least and the largest value
of all vectors, so the bounds hold for every vector and a few huge components leave the other cells as narrow as they were.
Bounds are floating-point numbers, widened by what rounding may have taken from them. Scores are exact 64-bit integers; a
component or a score beyond 64 bits is an error, as in ANSI SQL.

Equal vectors are stored once, with their k + 1 smallest ids: no other can stand in a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.llm.shared import dropped, new_path, written

SCALE = 64
TOP = 20
EVERY = 20
CELLS = 256
#: Vectors whose quantiles make the edges of the cells; all others are told apart by these edges too.
EDGE_SAMPLE = 20_000
#: Queries of one pass over the approximations; a pass holds them in every task, and compares so many at a time.
QUERY_BLOCK = 16_384
_QUERIES_AT_ONCE, _VECTORS_AT_ONCE = 2048, 512
#: Components reach to here, so that differences of two of them are 64-bit integers too.
MOST = 1 << 61


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (components floor(64 x) as little-endian 64-bit integers). Null and empty vectors and those with a null or non-finite component go; so do rows without vec_id."""

    def scale(batches):
        for batch in batches:
            ids, out = [], []
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or not x or any(c is None for c in x):
                    continue
                x = np.asarray(x, dtype=np.float64)
                if np.isfinite(x).all():
                    scaled = np.floor(SCALE * x)
                    if (np.abs(scaled) >= MOST).any():
                        raise OverflowError(f"a component of vector {vec_id} is out of the range of 64-bit integers")
                    ids.append(vec_id)
                    out.append(scaled.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(scale, "vec_id long, v binary")


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros, which add nothing to a product."""
    if not all(len(r) == 8 * width for r in rows):
        rows = [r.ljust(8 * width, b"\0") for r in rows]
    return np.frombuffer(b"".join(rows), dtype="<i8").reshape(-1, width)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; OverflowError where one is beyond 64 bits."""
    if not len(x):
        return np.zeros(0, np.int64)
    large = [int(max(abs(int(m.min())), abs(int(m.max())))) for m in (x, y)]
    if x.shape[1] * large[0] * large[1] < 1 << 63:
        return (x * y).sum(axis=1)
    return np.array([sum(a * b for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]).astype(object).astype(np.int64)


def cell_edges(distinct: DataFrame, width: int) -> np.ndarray:
    """width x (CELLS + 1): cell c of a dimension holds the values from edge c to just below edge c + 1."""

    def ends(batches):
        low = high = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0).to_pylist(), width)
                low = m.min(axis=0) if low is None else np.minimum(low, m.min(axis=0))
                high = m.max(axis=0) if high is None else np.maximum(high, m.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["low", "high"])

    rows = distinct.select("v").mapInArrow(ends, "low array<long>, high array<long>").collect()  # a row for each task
    low, high = np.min([r["low"] for r in rows], axis=0), np.max([r["high"] for r in rows], axis=0)
    few = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(EDGE_SAMPLE).collect()
    sample = np.sort(_matrix([bytes(r["v"]) for r in few], width), axis=0)
    edges = sample[(np.arange(1, CELLS) * len(sample)) // CELLS].T
    return np.hstack([low[:, None], np.clip(edges, low[:, None], high[:, None]), high[:, None] + 1])


def approximations(distinct: DataFrame, edges: np.ndarray) -> DataFrame:
    """place, sole (the vec_id where the vector has only one), cells: a byte for each dimension."""

    def cells(batches):
        for batch in batches:
            m = _matrix(batch.column(2).to_pylist(), len(edges))
            c = np.stack([np.searchsorted(e[1:-1], m[:, d], side="right") for d, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in c], pa.binary())], names=["place", "sole", "cells"])

    sole = F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).alias("sole")
    return distinct.select("place", sole, "v").mapInArrow(cells, "place long, sole long, cells binary")


def _scan(queries: np.ndarray, numbers: np.ndarray, ids: np.ndarray, edges: np.ndarray, top: int):
    """(query, place, least, most) of the vectors whose upper bound reaches the top-th largest lower bound of the task; without those of the query's vec_id only."""
    floats = queries.astype(np.float64)
    up, down, size = np.maximum(floats, 0), np.minimum(floats, 0), np.abs(floats).sum(axis=1)
    dims = np.arange(len(edges))

    def run(batches):
        best = np.full((len(queries), top), -np.inf)
        kept: list[tuple[np.ndarray, ...]] = []

        def sifted():
            q, p, lo, hi = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            ok = hi >= best[q, 0]
            return q[ok], p[ok], lo[ok], hi[ok]

        for batch in batches:
            for a in range(0, batch.num_rows, _VECTORS_AT_ONCE):
                part = batch.slice(a, _VECTORS_AT_ONCE)
                c = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8).reshape(-1, len(edges)).astype(np.int64)
                place = part.column(0).to_numpy()
                sole, known = pc.fill_null(part.column(1), 0).to_numpy(), np.asarray(part.column(1).is_valid())
                first, last = edges[dims, c].astype(np.float64), (edges[dims, c + 1] - 1).astype(np.float64)
                most_of_cell = np.maximum(np.abs(first), np.abs(last)).max(axis=1)
                for z in range(0, len(queries), _QUERIES_AT_ONCE):
                    y = slice(z, z + _QUERIES_AT_ONCE)
                    least, most = up[y] @ first.T + down[y] @ last.T, up[y] @ last.T + down[y] @ first.T
                    large = size[y][:, None] * most_of_cell  # no sum on the way is larger
                    wide = np.where(large < 2.0**52, 0.0, large * len(edges) * 2.0**-50)
                    own = known & (ids[y][:, None] == sole)
                    least, most = np.where(own, -np.inf, least - wide), most + wide
                    near = np.partition(np.hstack([best[y], least]), -top, axis=1)[:, -top:]
                    best[y] = np.sort(near, axis=1)
                    q, k = np.nonzero((most >= best[y][:, :1]) & ~own)
                    kept.append((q + z, place[k], least[q, k], most[q, k]))
            if len(kept) > 32:
                kept = [sifted()]
        q, p, lo, hi = sifted()
        for a in range(0, len(q), 100_000):
            z = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[q[z]]), pa.array(p[z]), pa.array(lo[z]), pa.array(hi[z])], names=["query", "place", "least", "most"])

    return run


def _exact(wanted: DataFrame, distinct: DataFrame, queries: np.ndarray, numbers: np.ndarray, ids: np.ndarray, width: int) -> DataFrame:
    """query, query_id, vec_id, score of the wanted (query, place), without rows of the query's own vec_id. numbers: ascending."""

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.searchsorted(numbers, batch.column(0).to_numpy())
            s = products(queries[q], _matrix(batch.column(1).to_pylist(), width))
            members = batch.column(2)
            n = np.diff(members.offsets.to_numpy())
            vec, of = members.flatten().to_numpy(), np.repeat(q, n)
            out = pa.RecordBatch.from_arrays([pa.array(numbers[of]), pa.array(ids[of]), pa.array(vec), pa.array(np.repeat(s, n))], names=["query", "query_id", "vec_id", "score"])
            yield out.filter(pa.array(ids[of] != vec))

    return wanted.select("query", "place").join(distinct, "place").select("query", "v", "ids").mapInArrow(score, "query long, query_id long, vec_id long, score long")


def _leading(rows: DataFrame, by: list, n: int, rank: str) -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy("query").orderBy(*by))).filter(F.col(rank) <= n)


def search(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score, query: of each query row its `top` best other rows by integer inner product, ties to the smaller vec_id.

    vectors: vec_id, embedding; other columns are left alone. is_query: a condition on vec_id. Vectors of several lengths meet
    in the components they share. A row that repeats vec_id and vector counts once. Rows of one vec_id with different vectors
    count each by itself: as candidates, and as queries, whose lists the number in column `query` tells apart; a query never
    meets a row of its own vec_id. Rows without a vec_id, and null, empty or non-finite vectors, take no part. No query or no
    vector gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(integers(vectors).distinct(), "vectors")
    few = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = written(distinct.withColumn("place", F.monotonically_increasing_id()), "distinct")
    schema = "query_id long, rank int, vec_id long, score long, query long"
    width = rows.agg(F.max(F.octet_length("v"))).first()[0]
    asking = written(rows.filter(is_query).select("vec_id", "v").withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = -(-asking.count() // QUERY_BLOCK)
    if not width or not blocks:
        return spark.createDataFrame([], schema)
    width //= 8
    edges = cell_edges(distinct, width)
    file = written(approximations(distinct, edges), "approximations")
    asking = asking.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    results = new_path(spark, "top")
    for b in range(blocks):
        mine = asking.filter(F.col("block") == b).orderBy("query").toArrow()  # about QUERY_BLOCK rows
        if not mine.num_rows:
            continue
        numbers, ids = mine["query"].to_numpy().astype(np.int64), mine["vec_id"].to_numpy().astype(np.int64)
        queries = _matrix(mine["v"].to_pylist(), width)
        found = written(file.mapInArrow(_scan(queries, numbers, ids, edges, top), "query long, place long, least double, most double"), "bounded")
        floor = _leading(found.select("query", "least"), [F.desc("least")], top, "r").groupBy("query").agg(F.min("least").alias("least_k"), F.count("*").alias("n"))
        open_ = written(found.join(floor, "query").filter((F.col("n") < top) | (F.col("most") >= F.col("least_k"))).select("query", "place", "most"), "open")
        first = _leading(open_, [F.desc("most"), "place"], top, "r").select("query", "place", "most")
        known = written(_leading(_exact(first, distinct, queries, numbers, ids, width), [F.desc("score"), "vec_id"], top, "rank"), "known")
        sure = known.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        later = open_.join(first.select("query", "place"), ["query", "place"], "left_anti").join(sure, "query", "left")
        later = later.filter((F.coalesce("n", F.lit(0)) < top) | (F.col("most") >= F.col("kth"))).select("query", "place")
        every = known.drop("rank").union(_exact(later, distinct, queries, numbers, ids, width))
        _leading(every, [F.desc("score"), "vec_id"], top, "rank").select("query_id", F.col("rank").cast("int"), "vec_id", "score", "query").write.mode("append").parquet(results)
        dropped(found, open_, known)
    dropped(file)
    return spark.read.schema(schema).parquet(results)


def op5_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every 20th vector among all others."""
    found = search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)
    return found.drop("query")


ORACLE_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM c q JOIN c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
