"""SimHash fingerprints of documents, and all of them within a Hamming radius by permuted block tables.

Terms are 2-word shingles, weighted by how often they occur: each occurrence votes with the signed bits of its
hash, and the sign of the sums is the fingerprint. Equal fingerprints are one class before they are compared.

The radius follows from a similarity of shingle sets: a bit of two texts of shingle cosine c differs with probability
acos(c) / pi, and RADIUS is the least that RECALL of the pairs of Jaccard similarity SIMILARITY stay within.

The block tables are exact: there is a group of bits for each GROUP_RADIUS + 1 bits of the radius begun, so two fingerprints
within the radius differ in at most GROUP_RADIUS bits of some group. A group has PIECES pieces, of which all but
GROUP_RADIUS then agree; there is a table for each choice of these. Those that agree there meet, and the full distance
decides. A list gives only as many links as join what is near in it, so large groups of near copies cost no pairs by the square.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.minhash_join import components
from sievegrid.llm.shared import documents, dropped, freed, joined, written
from sievegrid.llm.textbytes import U64, mix64, pair_hashes, slices, tidy, word_hashes

WORDS64 = 2
BITS = 64 * WORDS64
SIMILARITY, RECALL = 0.95, 0.95
GROUP_RADIUS, PIECES = 2, 5
#: Keys that a task deals at once, keys of a table in a part, and the longest list whose pairs are compared one shift after the other.
_KEYS_AT_ONCE, _PART, _LONG = 500_000, 200_000, 512
#: Shingles of a text that vote at once.
_VOTERS_AT_ONCE = 1 << 15


def radius_of(similarity: float, recall: float = RECALL) -> int:
    """The least radius that holds this share of the pairs of sets, alike in size, of the Jaccard similarity."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    r, held = 0, (1 - p) ** BITS
    while held < recall:
        r += 1
        held += math.comb(BITS, r) * p**r * (1 - p) ** (BITS - r)
    return r


RADIUS = radius_of(SIMILARITY)

_SALT = mix64(np.arange(71, 71 + WORDS64, dtype=U64))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A row of BITS / 8 bytes for each text; zeros for texts without words. A bit is set where the votes for it are more than half."""
    p, off = pair_hashes(*word_hashes(texts))
    out = np.zeros((len(off) - 1, BITS), dtype=bool)
    for i, (x, y) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        votes = np.zeros(BITS, dtype=np.int64)
        for a in range(x, y, _VOTERS_AT_ONCE):
            h = p[a : min(a + _VOTERS_AT_ONCE, y)]
            for w in range(WORDS64):
                votes[64 * w : 64 * w + 64] += np.unpackbits(mix64(h ^ _SALT[w]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[i] = 2 * votes > y - x
    return np.packbits(out, axis=1)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of bits in which rows agree."""
    return 1 - np.bitwise_count(x ^ y).sum(axis=1) / BITS


def table_masks(radius: int) -> np.ndarray:
    """A row of WORDS64 words for each block table, with the bits that agree there; one row for each table of a group after the other."""
    groups = radius // (GROUP_RADIUS + 1) + 1
    edges = [round(k * BITS / (groups * PIECES)) for k in range(groups * PIECES + 1)]
    out = []
    for g in range(groups):
        for chosen in itertools.combinations(range(g * PIECES, (g + 1) * PIECES), PIECES - GROUP_RADIUS):
            bits = np.zeros(BITS, dtype=np.uint8)
            for k in chosen:
                bits[edges[k] : edges[k + 1]] = 1
            out.append(np.packbits(bits).view(">u8").astype(U64))
    return np.stack(out)


def _tokens(prints: np.ndarray, mask: np.ndarray) -> np.ndarray:
    token = np.zeros(len(prints), dtype=U64)
    for k in range(WORDS64):
        token = mix64(token ^ (prints[:, k] & mask[k]))
    return token


def _words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=">u8").reshape(-1, WORDS64).astype(U64)


def block_tables(classes: DataFrame, masks: dict[int, np.ndarray], parts: int) -> DataFrame:
    """part, keys (one after the other): the fingerprints of each table, dealt to parts by the bits that agree there."""

    def deal(prints):
        for table, mask in masks.items():
            part = (_tokens(prints, mask) % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            named, first = np.unique(part[order], return_index=True)
            lists = np.split(prints[order].astype(">u8"), first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(table * parts + named), pa.array([x.tobytes() for x in lists], pa.binary())], names=["part", "keys"])

    def cut(batches):
        kept, n = [], 0
        for batch in batches:
            kept.append(_words(batch.column(0).to_pylist()))
            n += batch.num_rows
            if n >= _KEYS_AT_ONCE:
                yield from deal(np.concatenate(kept))
                kept, n = [], 0
        if n:
            yield from deal(np.concatenate(kept))

    return classes.select("key").mapInArrow(cut, "part long, keys binary")


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= radius


def _links_in_long(prints: np.ndarray, radius: int):
    """(left, right) rows of links that join what is near: each row once meets those that nothing has reached."""
    unmet = np.arange(len(prints))
    while len(unmet):
        reached, unmet = [int(unmet[0])], unmet[1:]
        while reached and len(unmet):
            k = reached.pop()
            near = _near(prints[unmet], prints[k], radius)
            if near.any():
                found = unmet[near]
                yield np.full(len(found), k), found
                reached += found.tolist()
                unmet = unmet[~near]


def links_of_lists(prints: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) fingerprints: links of the lists of a table, from each row to the smallest one that steps within the radius in its list reach."""
    token = _tokens(prints, mask)
    order = np.lexsort((*prints.T[::-1], token))
    prints, token = prints[order], token[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, n in zip(first[size > _LONG].tolist(), size[size > _LONG].tolist(), strict=True):
        for x, y in _links_in_long(prints[a : a + n], radius):
            left.append(a + x)
            right.append(a + y)
    after = np.repeat(np.where(size > _LONG, 0, size), size) - (np.arange(len(token)) - np.repeat(first, size)) - 1  # rows that follow in the list
    at, shift = np.flatnonzero(after > 0), 1
    while len(at):
        near = at[_near(prints[at], prints[at + shift], radius)]
        left.append(near)
        right.append(near + shift)
        shift += 1
        at = at[after[at] >= shift]
    left, right = np.concatenate(left), np.concatenate(right)
    root, before = np.arange(len(token)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
    some = np.flatnonzero(root != np.arange(len(token)))
    return prints[root[some]], prints[some]


def linked(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """key, near_class, copies for the fingerprints in prints (key, first_id): the smallest first_id that chains of steps within the radius reach, and rows of the fingerprint.

    The fingerprint of texts without words is near no other one. Null ids come last; a class of null ids only has null.
    """
    classes = written(prints.groupBy("key").agg(F.min("first_id").alias("first_id"), F.count("*").alias("copies")), "prints")
    worded = classes.filter(F.col("key") != F.lit(bytes(BITS // 8)))
    parts = max(64, worded.count() // _PART)
    masks, links = table_masks(radius), []
    per_group = math.comb(PIECES, GROUP_RADIUS)

    def near(table: pa.Table) -> pa.Table:
        found = links_of_lists(_words(table["keys"].to_pylist()), masks[table["part"][0].as_py() // parts], radius)
        return pa.table({name: pa.array([k.tobytes() for k in x.astype(">u8")], pa.binary()) for name, x in zip("ab", found, strict=True)})

    for a in range(0, len(masks), per_group):  # the tables of one group at a time, as they are dealt over disk
        posted = block_tables(worded, dict(enumerate(masks[a : a + per_group], a)), parts)
        links.append(written(posted.groupBy("part").applyInArrow(near, "a binary, b binary").distinct(), "near"))
        del posted
        freed(prints.sparkSession)
    labels = written(components(functools.reduce(DataFrame.union, links)), "labels")
    dropped(*links)
    known = classes.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = known.groupBy("component").agg(F.min("first_id").alias("near_class"), F.count("*").alias("classes"))
    out = written(joined(known, least, "component", "classes", classes.count()).select("key", "near_class", "copies"), "near-class")
    dropped(classes, labels)
    return out


def compared(docs: DataFrame) -> DataFrame:
    """Each document in descending doc_id beside its edited text and the next document (after the last: the first).

    The edited text is the text with its last third of code points replaced by as many of the next document's first.
    Null texts are empty; equal doc_ids stand in descending order of their texts, so rows that repeat follow each other; rows
    without a doc_id come last, in the same order; a lone document is next to itself. An empty table gives no rows.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), F.desc("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next", "part", "head", "tail"]

    def results(ids, texts, prints, next_prints, next_texts, part):
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, next_texts, strict=True)]
        fresh = fingerprints(pa.array(edited, pa.string()))
        digest = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digest, pa.string()), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([p.tobytes() for p in fresh], pa.binary())]
            + [pa.array(likeness(prints, fresh)), pa.array(likeness(prints, next_prints)), pa.array([part] * n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
            names=names,
        )

    def walk(batches):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            for a, b in slices(batch.column(1)):
                column = batch.column(1).slice(a, b - a)
                prints, texts, ids = fingerprints(column), column.to_pylist(), batch.column(0).slice(a, b - a).to_pylist()
                if last is None:
                    yield _edge(names, part, "head", ids[0], texts[0])
                else:
                    ids, texts, prints = [last[0], *ids], [last[1], *texts], np.vstack([last[2][None], prints])
                if len(ids) > 1:
                    yield results(ids[:-1], texts[:-1], prints[:-1], prints[1:], texts[1:], part)
                last = ids[-1], texts[-1], prints[-1]
        if last is not None:
            yield _edge(names, part, "tail", last[0], last[1])

    schema = "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double, part long, head string, tail string"
    rows = written(ordered.mapInArrow(tidy(walk), schema), "compared")
    parts = sorted(r["part"] for r in rows.filter("head is not null").select("part").collect())  # numbers of the partitions
    after = dict(zip(parts, [*parts[1:], *parts[:1]], strict=True))
    spark = docs.sparkSession
    follow = spark.createDataFrame(sorted(after.items()), "part long, after long")
    heads = rows.filter("head is not null").select(F.col("part").alias("after"), F.col("head").alias("next_text"))
    tails = rows.filter("tail is not null").select("part", "doc_id", "tail").join(follow, "part").join(heads, "after").select("part", "doc_id", "tail", "next_text")

    def join_edges(batches):
        for batch in batches:
            texts, following = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if texts:
                yield results(batch.column(1).to_pylist(), texts, fingerprints(batch.column(2)), fingerprints(batch.column(3)), following, 0)

    out = rows.filter("head is null and tail is null").union(tails.mapInArrow(join_edges, schema))
    return out.drop("part", "head", "tail")


def _edge(names, part, kind, doc_id, text):
    row = dict.fromkeys(names) | {"part": part, "doc_id": doc_id, kind: text}
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("print", pa.binary()), ("edited_print", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int64()), ("head", pa.string()), ("tail", pa.string())])
    return pa.RecordBatch.from_pylist([row], schema=schema)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the class of documents within the Hamming radius."""
    rows = compared(documents(spark, sf_dir))
    freed(spark)
    near = linked(rows.select(F.col("print").alias("key"), F.col("doc_id").alias("first_id")))
    out = joined(rows, near.withColumnRenamed("key", "print"), "print", "copies", rows.count())
    hexed = [F.lower(F.hex(c)).alias(name) for c, name in (("print", "fingerprint"), ("edited_print", "edited_fingerprint"))]
    return out.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next", "near_class")
