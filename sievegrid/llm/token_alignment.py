"""Alignment of two tokenizers by interval coalescing.

Tokens of either tokenizer are byte ranges of one text. Sorted by start, both kinds together, a group ends where a token starts
at or beyond the running maximum of the ends before it; within a group every pair of ranges that overlap is a link.
All texts of a slice are aligned in one go, as their ranges follow one another.

How often a pair of ids is linked in the whole corpus is counted over blocks: a block of texts holds each of its pairs once,
with its number, and refers to it by a small number from its documents. Pairs are summed by Spark, the sums go back to the
blocks, and a block's documents add them up. A pair stands once in a block at most, so no pair is a hot key, and no task
gets more than a block of texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.shared import documents, dropped, written
from sievegrid.llm.textbytes import packed, slices, tidy
from sievegrid.llm.tokens import Encoder, tokenizer_path

#: A block ends with the slice that brings it to so many bytes of text, or so many documents.
BLOCK_BYTES, BLOCK_ROWS = 6 << 20, 50_000
_B = 32  # bits of the second id in a pair


class Pieces:
    """The bytes of all ids of a vocabulary, in one array."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        to = np.cumsum(size)
        return self.flat[np.repeat(self.begin[ids] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]


def _byte_of_letter() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: visible Latin-1 signs stand for themselves, all other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """The first tokenizer: a byte-level vocabulary file; strings of special tokens are plain text to it."""

    _kept: dict[str, ByteLevel] = {}

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.library.encode_special_tokens = True
        self.encoder.special = []
        letters = _byte_of_letter()
        names = {i: p for p, i in self.encoder.library.get_vocab(with_added_tokens=True).items()}
        self.pieces = Pieces([bytes(letters.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)])

    @classmethod
    def of(cls, path: str) -> ByteLevel:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def ids(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, off = self.encoder.ids(spaced)
        return ids.astype(np.int64), off


class Piecewise:
    """The second tokenizer: a sentence-piece model, which puts a space before each text itself."""

    _kept: dict[str, Piecewise] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = Pieces([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.library.id_to_piece(i)) for i in range(n))])

    @classmethod
    def of(cls, path: str) -> Piecewise:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x, dtype=np.int64) for x in self.library.encode(texts.to_pylist(), num_threads=1)]
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])


@dataclass
class Side:
    """Tokens of one tokenizer: ids, byte ranges over all texts together, number of the text, number of the group."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    group: np.ndarray | None = None


@dataclass
class Alignment:
    rows: int
    a: Side
    b: Side
    base: np.ndarray  # first byte of each text among those that have tokens

    def per_row(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=self.rows)

    def n_groups(self) -> np.ndarray:
        group, first = np.unique(self.a.group, return_index=True)
        return self.per_row(self.a.of[first])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places among a's and b's tokens of all pairs whose ranges overlap."""
        first, last = np.searchsorted(self.b.end, self.a.start, side="right"), np.searchsorted(self.b.start, self.a.end, side="left")
        n = last - first
        to = np.cumsum(n)
        return np.repeat(np.arange(len(n)), n), np.repeat(first - (to - n), n) + np.arange(to[-1] if len(to) else 0)

    def written_groups(self, digits: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;a3|b2,b3` of each text, as bytes and offsets."""
        ids = np.concatenate([self.a.ids, self.b.ids])
        key = np.concatenate([2 * self.a.group, 2 * self.b.group + 1])
        order = np.argsort(key, kind="stable")
        ids, key, of = ids[order], key[order], np.concatenate([self.a.of, self.b.of])[order]
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(self.rows + 1, np.int64)
        mark = np.full(len(ids), ord(","), dtype=np.uint8)
        mark[1:][key[1:] != key[:-1]] = ord("|")
        mark[1:][key[1:] >> 1 != key[:-1] >> 1] = ord(";")
        opens = np.ones(len(ids), dtype=bool)
        opens[1:] = of[1:] != of[:-1]
        size = digits.size[ids] + ~opens
        to = np.cumsum(size)
        out = np.empty(to[-1], dtype=np.uint8)
        is_mark = np.zeros(to[-1], dtype=bool)
        is_mark[(to - size)[~opens]] = True
        out[is_mark] = mark[~opens]
        out[~is_mark] = digits.joined(ids)
        return out, np.concatenate([[0], to])[np.searchsorted(of, np.arange(self.rows + 1))]


def align(texts: pa.Array, first: ByteLevel, second: Piecewise) -> Alignment:
    """Tokens and groups of each text. Texts that are null or empty, or whose tokens of either kind don't join to a space and the text, have none."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
    buf, off = packed(spaced)
    rows, size = len(texts), np.diff(off)
    given, good = [], size > 1
    for tokenizer, column in ((first, spaced), (second, texts)):
        ids, at = tokenizer.ids(column)
        given.append((ids, np.repeat(np.arange(rows), np.diff(at)), tokenizer.pieces))
        good &= np.bincount(given[-1][1], weights=tokenizer.pieces.size[ids], minlength=rows).astype(np.int64) == size
    for ids, of, pieces in given:
        text_of = np.repeat(np.arange(rows), np.where(good, size, 0))
        wrong = pieces.joined(ids[good[of]]) != buf[np.repeat(good, size)]
        good[text_of[wrong]] = False
    sides = []
    for ids, of, pieces in given:
        ids, of = ids[good[of]], of[good[of]]
        end = np.cumsum(pieces.size[ids])
        sides.append(Side(ids, end - pieces.size[ids], end, of))
    a, b = sides
    start, end = np.concatenate([a.start, b.start]), np.concatenate([a.end, b.end])
    order = np.lexsort((np.arange(len(start)) >= len(a.start), start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    a.group, b.group = group[: len(a.start)], group[len(a.start) :]
    return Alignment(rows, a, b, np.cumsum(np.where(good, size, 0)) - np.where(good, size, 0))


def _paths(first: str | None, second: str | None) -> tuple[str, str]:
    return first or tokenizer_path(), second or tokenizer_path("piece_bpe_32k.model")


def spans(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, a, b of every row of docs: the tokens of each tokenizer, arrays of (id, start, end, group); bytes are counted from the space before the text, groups from 0."""
    paths = _paths(first, second)
    token = "array<struct<id:int,start:long,end:long,group:long>>"

    def work(batches):
        tokenizers = ByteLevel.of(paths[0]), Piecewise.of(paths[1])
        for batch in batches:
            for x, y in slices(batch.column(1)):
                found = align(batch.column(1).slice(x, y - x), *tokenizers)
                lowest = np.zeros(found.rows, dtype=np.int64)
                lowest[found.a.of[::-1]] = found.a.group[::-1]
                out = []
                for s in (found.a, found.b):
                    parts = [pa.array(s.ids.astype(np.int32)), pa.array(s.start - found.base[s.of]), pa.array(s.end - found.base[s.of]), pa.array(s.group - lowest[s.of])]
                    values = pa.StructArray.from_arrays(parts, names=["id", "start", "end", "group"])
                    out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(s.of, np.arange(found.rows + 1)).astype(np.int32)), values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *out], names=["doc_id", "a", "b"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), f"doc_id long, a {token}, b {token}")


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, first the lowest bytes of all, then the next: small numbers leave zeros that compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCK = f"block long, doc_id array<long>, {', '.join(f'{c} array<long>' for c in _NUMBERS)}, groups_sha256 array<string>, used binary, local binary, times binary, pairs binary, counts binary"


class _Block:
    """Documents of a block and their links, and the row they make."""

    def __init__(self):
        self.ids, self.numbers, self.digests, self.pairs, self.of, self.rows, self.size = [], [], [], [], [], 0, 0

    def add(self, ids: pa.Array, found: Alignment, digits: Pieces, size: int) -> None:
        x, y = found.links()
        self.ids.append(ids)
        self.numbers.append([found.per_row(found.a.of), found.per_row(found.b.of), found.n_groups(), found.per_row(found.a.of[x])])
        out, at = found.written_groups(digits)
        view, at = memoryview(out), at.tolist()
        self.digests += [hashlib.sha256(view[p:q]).hexdigest() if q > p else "" for p, q in zip(at[:-1], at[1:], strict=True)]
        self.pairs.append((found.a.ids[x] << _B) | found.b.ids[y])
        self.of.append(found.a.of[x] + self.rows)
        self.rows, self.size = self.rows + found.rows, self.size + size

    def row(self, number: int) -> pa.RecordBatch:
        pairs, local, counts = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent pairs get small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        key, times = np.unique(np.concatenate(self.of) * max(len(pairs), 1) + rank[local], return_counts=True)
        row, local = np.divmod(key, max(len(pairs), 1))
        step = np.diff(local, prepend=0)
        first = np.ones(len(row), dtype=bool)
        first[1:] = row[1:] != row[:-1]
        step[first] = local[first]
        columns = [number, pa.concat_arrays(self.ids).to_pylist(), *(np.concatenate([n[k] for n in self.numbers]).tolist() for k in range(len(_NUMBERS))), self.digests]
        columns += [_planes(np.bincount(row, minlength=self.rows)), _planes(step), _planes(times), pairs[order].astype("<i8").tobytes(), counts[order].astype("<i8").tobytes()]
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names=names)


def blocks(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Aligned documents by blocks of bounded size (a longer text has one of its own)."""
    paths = _paths(first, second)

    def work(batches):
        from pyspark import TaskContext

        tokenizers = ByteLevel.of(paths[0]), Piecewise.of(paths[1])
        digits = Pieces([b"%d" % i for i in range(max(len(t.pieces.size) for t in tokenizers))])
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for x, y in slices(batch.column(1)):
                column = batch.column(1).slice(x, y - x)
                block.add(batch.column(0).slice(x, y - x), align(column, *tokenizers), digits, len(packed(column)[0]))
                if block.size >= BLOCK_BYTES or block.rows >= BLOCK_ROWS:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.rows:
            yield block.row(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), _BLOCK)


def block_pairs(table: DataFrame) -> DataFrame:
    """block, local (the pair's number in the block), pair, links."""

    def work(batches):
        for batch in batches:
            for block, pairs, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                pairs, counts = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
                for k in range(0, len(pairs), 1 << 15):
                    part = pairs[k : k + (1 << 15)]
                    own = [pa.array(np.full(len(part), block)), pa.array(np.arange(k, k + len(part)).astype(np.int32)), pa.array(part), pa.array(counts[k : k + (1 << 15)])]
                    yield pa.RecordBatch.from_arrays(own, names=["block", "local", "pair", "links"])

    return table.select("block", "pairs", "counts").mapInArrow(tidy(work), "block long, local int, pair long, links long")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, links, best of all blocks together: how many links hold the pair, and whether no other pair of the same b has more."""
    totals = written(block_pairs(table).groupBy("pair").agg(F.sum("links").alias("links")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit((1 << _B) - 1))
    most = totals.groupBy(second.alias("b")).agg(F.max("links").alias("most"))  # a row for each id of a vocabulary
    out = totals.join(F.broadcast(most), second == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    out.written_path = totals.written_path
    return out


def _summed(table: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of one block, with n_best and count_sum from the counts of its pairs."""
    links, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
    local = known["local"].to_numpy()
    links[local], best[local] = known["links"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
    (row,) = table.to_pylist()
    used, step, times = (_from_planes(row[c]) for c in ("used", "local", "times"))
    of = np.repeat(np.arange(len(used)), used)
    sums = np.cumsum(step)
    first = np.cumsum(used) - used
    before = np.concatenate([[0], sums])[first]
    local = sums - before[of]
    totals = []
    for x in (times * best[local] if len(local) else local, times * links[local] if len(local) else local):
        c = np.concatenate([[0], np.cumsum(x)])
        totals.append(c[first + used] - c[first])
    numbers = {c: pa.array(row[c], pa.int64()) for c in ["doc_id", *_NUMBERS]}
    return pa.table(numbers | {"n_best": pa.array(totals[0]), "count_sum": pa.array(totals[1]), "groups_sha256": pa.array(row["groups_sha256"], pa.string())})


def measured(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text; other columns are left alone).

    n_best: links whose pair of ids has as many links in the corpus as the best pair of its b id, ties included. count_sum: the
    corpus-wide links of the pair, over all links of the text. groups_sha256: of the ids by groups. Null and empty texts, and texts that either tokenizer
    changes, have zeros and ''. Rows that repeat or lack a doc_id stand for themselves, and their links count as often
    as they stand. Very long texts are read whole. An empty table gives no rows.
    """
    table = written(blocks(docs, first, second), "aligned")
    counts = pair_counts(table)
    known = block_pairs(table).select("block", "local", "pair").join(counts, "pair").select("block", "local", "links", "best")
    left = table.drop("pairs", "counts").groupBy("block")
    out = left.cogroup(known.groupBy("block")).applyInArrow(_summed, f"doc_id long, {', '.join(f'{c} long' for c in [*_NUMBERS, 'n_best', 'count_sum'])}, groups_sha256 string")
    result = written(out, "alignment")
    dropped(table, counts)
    return result


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents between the byte-level and the sentence-piece vocabulary."""
    return measured(documents(spark, sf_dir))
