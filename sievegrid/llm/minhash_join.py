"""Near-duplicate detection by a MinHash signature-coordinate inverted join.

A document is the set of its distinct 2-word shingles (64-bit hashes). Equal sets form one class. A class has
`COORDINATES` minima; each (coordinate, value) pair is a token under which the class is posted. Two classes are
candidates when at least `LEAST_MATCHES` of their tokens agree. Tokens are ordered by how many classes post
them, and each class leaves out its LEAST_MATCHES - 1 most frequent ones: two classes with that many tokens in
common still meet under one of the rest, so frequent passages are skipped without losing a pair. Long posting
lists are cut into blocks that meet pairwise in tasks of their own, and a task emits only pairs over the
threshold. Candidates are confirmed on the full sets.

A class also carries parities: bit b tells whether an odd number of its shingles hash to b. The parities of two sets
differ in at most as many bits as the sets differ in shingles, so pairs that differ in more bits than the similarity
allows shingles are no candidates. This loses nothing, and leaves few pairs that the full sets refuse.

Components come in two rounds, so that a group of thousands of near copies costs no pairs by the square: first
each class is compared with one partner per list, then all pairs whose components still differ are.

A pair of similarity 0.8 misses the threshold of 10 of 24 with probability below 1e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.llm.shared import documents, dropped, joined, written
from sievegrid.llm.textbytes import U64, mix64, pair_hashes, slices, tidy, word_hashes

COORDINATES = 24
LEAST_MATCHES = 10
BLOCK = 256
PERCENT = 80
PARITY_BITS = 1024
_PAIRS_AT_ONCE = 400_000

_MULTIPLY = mix64(np.arange(101, 101 + COORDINATES, dtype=U64)) | U64(1)
_ADD = mix64(np.arange(501, 501 + COORDINATES, dtype=U64))
_NAME = mix64(np.arange(901, 901 + COORDINATES, dtype=U64))
#: The entries of each row after the first are the sums with earlier ones; equal to hashes of equal sets whatever the order.
_KEY_MASK = U64(0x5851F42D4C957F2D)


def shingle_sets(texts: pa.Array):
    """For each slice of the column: (first row, hashes of distinct shingles in ascending order, their offsets)."""
    for a, b in slices(texts):
        h, at = pair_hashes(*word_hashes(texts.slice(a, b - a)))
        parts, sizes = [], np.zeros(b - a, dtype=np.int64)
        for i in range(b - a):
            if at[i + 1] > at[i]:
                s = np.sort(h[at[i] : at[i + 1]])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
                parts.append(s)
                sizes[i] = len(s)
        yield a, (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def set_keys(h: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, equal for equal sets; none for empty ones."""
    n = np.diff(off)
    first = off[:-1][n > 0]
    keys: list[bytes | None] = [None] * len(n)
    if len(first):
        two = np.stack([mix64(np.add.reduceat(h, first)), mix64(np.add.reduceat(mix64(h ^ _KEY_MASK), first))], axis=1).astype(">u8")
        for i, k in zip(np.flatnonzero(n > 0).tolist(), two, strict=True):
            keys[i] = k.tobytes()
    return keys


def _signatures(batches):
    for batch in batches:
        for a, h, off in shingle_sets(batch.column(2)):
            n = np.diff(off)
            full = n > 0
            minima = np.zeros((len(n), COORDINATES), dtype=U64)
            if full.any():
                for c in range(COORDINATES):
                    minima[full, c] = np.minimum.reduceat(mix_fast(h, c), off[:-1][full])
            tokens = mix64(minima ^ _NAME).view(np.int64)
            bit = np.repeat(np.arange(len(n)), n) * PARITY_BITS + (h % U64(PARITY_BITS)).astype(np.int64)
            odd = np.packbits(np.bincount(bit, minlength=len(n) * PARITY_BITS).reshape(len(n), -1) & 1, axis=1)
            marks = np.hstack([minima.astype(np.uint32), odd.view(np.uint32)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, len(n)),
                    batch.column(1).slice(a, len(n)),
                    pa.array(n),
                    pa.array(set_keys(h, off), pa.binary()),
                    pa.array([marks[i].tobytes() if f else None for i, f in enumerate(full.tolist())], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES), pa.array(tokens.ravel())),
                ],
                names=["row", "doc_id", "n_shingles", "key", "marks", "tokens"],
            )


def mix_fast(h: np.ndarray, c: int) -> np.ndarray:
    """The c-th hash function of the signature."""
    x = h * _MULTIPLY[c] + _ADD[c]
    x ^= x >> U64(32)
    return x


def signed(numbered: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, key of the set, marks (32 bits of each minimum, parities), tokens (64-bit names of the coordinate-value pairs) of rows (row, doc_id, text)."""
    rows = numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_signatures), "row long, doc_id long, n_shingles long, key binary, marks binary, tokens array<long>")


def postings(classes: DataFrame) -> DataFrame:
    """token, i, j (blocks that meet), block, key, n_shingles, marks: the inverted lists without each class's most frequent tokens."""
    posted = classes.select("key", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    order = Window.partitionBy("key").orderBy(F.desc("df"), F.desc("token"))
    kept = posted.join(shared, "token").withColumn("place", F.row_number().over(order)).filter(F.col("place") > LEAST_MATCHES - 1)
    rows = kept.select("key", "token", "df").join(classes.select("key", "n_shingles", "marks"), "key")
    return blocked(rows)


def blocked(rows: DataFrame) -> DataFrame:
    """The rows (key, token, df, n_shingles, marks) of lists over BLOCK long, dealt to pairs of blocks."""
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("token", "key", "n_shingles", "marks", "block", other)
    return rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n_shingles", "marks")


def _whole_groups(batches):
    """Tables that hold whole groups of equal (token, i, j), from sorted batches."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and not _same_group(kept[-1], kept[-1].num_rows - 1, batch, 0):
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
        last = batch.num_rows - 1
        names = [batch.column(k).to_numpy() for k in range(3)]
        differ = np.flatnonzero((names[0] != names[0][last]) | (names[1] != names[1][last]) | (names[2] != names[2][last]))
        cut = int(differ[-1]) + 1 if len(differ) else 0
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _same_group(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
    return all(a.column(k)[i] == b.column(k)[j] for k in range(3))


def _pairs_of_groups(first: np.ndarray, size: np.ndarray):
    """(left, right) row numbers of all pairs within the groups, some groups at a time."""
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    before = np.cumsum(place)
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(before, (before[at - 1] if at else 0) + _PAIRS_AT_ONCE, side="right")))
        q = place[at:to]
        right = np.repeat(np.arange(at, to), q)
        left = np.repeat(np.arange(at, to) - q, q) + np.arange(len(right)) - np.repeat(np.cumsum(q) - q, q)
        if len(right):
            yield left, right
        at = to


class Agreement:
    """Marks of two classes agree in enough coordinates, and neither sizes nor parities rule the similarity out."""

    def read(self, marks: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(marks), dtype=np.uint32).reshape(-1, COORDINATES + PARITY_BITS // 32)

    def allowed(self, marks: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows are candidates."""
        ok = np.flatnonzero(100 * np.minimum(n[left], n[right]) >= PERCENT * np.maximum(n[left], n[right]))
        first, rest = marks[:, :COORDINATES], marks[:, COORDINATES:]
        ok = ok[(first[left[ok]] == first[right[ok]]).sum(axis=1) >= LEAST_MATCHES]
        bits = np.bitwise_count(rest[left[ok]] ^ rest[right[ok]]).sum(axis=1, dtype=np.int64)
        # |x ∩ y| >= s |x ∪ y| means |x Δ y| <= (|x| + |y|) (1 - s) / (1 + s)
        ok = ok[(100 + PERCENT) * bits <= (100 - PERCENT) * (n[left[ok]] + n[right[ok]])]
        out = np.zeros(len(left), dtype=bool)
        out[ok] = True
        return out


def _candidates(star: bool, rule):
    """Pairs (a, b) that the rule allows, of different components; star: for each row one partner only."""

    def run(batches):
        for table in _whole_groups(batches):
            token, i, j, block = (table.column(k).to_numpy() for k in range(4))
            n = table["n_shingles"].to_numpy()
            marks = rule.read(table["marks"].to_pylist())
            keys = table["key"].to_pylist()
            label = table["component"].to_pylist()
            _, label = np.unique(np.array(label, dtype="S16"), return_inverse=True)
            rank = np.empty(len(keys), dtype=np.int64)
            rank[np.argsort(np.array(keys, dtype="S16"), kind="stable")] = np.arange(len(keys))
            change = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            size = np.diff(np.append(change, len(token)))
            best = np.full(len(token), np.iinfo(np.int64).max)
            partner = np.full(len(token), -1, dtype=np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for left, right in _pairs_of_groups(change, size):
                ok = (label[left] != label[right]) & ((i[left] == j[left]) | (block[left] != block[right]))
                left, right = left[ok], right[ok]
                ok = rule.allowed(marks, n, left, right)
                left, right = left[ok], right[ok]
                if not star:
                    found.append((left, right))
                    continue
                for x, y in ((left, right), (right, left)):
                    order = np.lexsort((rank[y], x))
                    x, y = x[order], y[order]
                    one = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
                    x, y = x[one], y[one]
                    better = rank[y] < best[x]
                    best[x[better]], partner[x[better]] = rank[y[better]], y[better]
            if star:
                x = np.flatnonzero(partner >= 0)
                found = [(x, partner[x])]
            for left, right in found:
                if len(left):
                    low = np.where(rank[left] < rank[right], left, right).tolist()
                    high = np.where(rank[left] < rank[right], right, left).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in low], pa.binary()), pa.array([keys[k] for k in high], pa.binary())], names=["a", "b"])

    return run


def candidates(posted: DataFrame, labels: DataFrame | None, star: bool, rule=None) -> DataFrame:
    """Distinct candidate pairs a < b of different components."""
    if labels is None:
        rows = posted.withColumn("component", F.col("key"))
    else:
        rows = posted.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = rows.select("token", "i", "j", "block", "key", "n_shingles", "marks", "component")
    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(tidy(_candidates(star, rule or Agreement())), "a binary, b binary").distinct()


def full_sets(numbered: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, shingles (ascending 64-bit hashes) of the classes in pairs, from the first row of each class."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    one = classes.select("key", F.col("first.row").alias("row")).join(wanted, "key", "left_semi")
    rows = numbered.select("row", F.col("text").cast("string").alias("text")).join(one, "row").select("key", "text")

    def again(batches):
        for batch in batches:
            for a, h, off in shingle_sets(batch.column(1)):
                mine = [h[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(mine)), pa.array(mine, pa.binary())], names=["key", "shingles"])

    return rows.mapInArrow(tidy(again), "key binary, shingles binary")


def _similar(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return rows.mapInArrow(tidy(_similar), "a binary, b binary")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction; links (u, v) have u > v. A hub's links stay where they are and look its least neighbour up."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")).select("u", F.least("u", "m").alias("m"), "links")
    near = joined(both, low, "u", "links", (2 if large else 1) * links.count())
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """key, component (the smallest key reachable) for every key in links (a, b), by alternating star contraction."""
    now, before = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark["n"]:
            break
        before, old = mark, now
        now = written(_star(written(_star(now, True), "large"), False), "links")
        dropped(old)
    return now.select(F.col("u").alias("key"), F.col("v").alias("component")).union(now.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Null, empty and blank texts have no shingles, are their own component and kept. Of each other component one row is
    kept, the first by doc_id (null ones last), whose doc_id names it; rows that share a doc_id, or have none, are
    compared and kept or not each by itself. An empty table gives no rows.
    """
    numbered = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    out = kept_rows(numbered)
    dropped(numbered)
    return out.drop("row")


def kept_rows(numbered: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept of a written table whose rows (row, doc_id, text) are numbered."""
    sets = written(signed(numbered), "signed")
    full = sets.filter("n_shingles > 0")
    classes = written(full.groupBy("key").agg(F.first("n_shingles").alias("n_shingles"), F.first("marks").alias("marks"), F.first("tokens").alias("tokens"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"), F.count("*").alias("copies")), "classes")
    posted = written(postings(classes), "postings")
    star = written(candidates(posted, None, star=True), "pairs")
    shingles = written(full_sets(numbered, classes, star), "sets")
    links = written(confirmed(star, shingles), "confirmed")
    labels = written(components(links), "labels")
    rest = written(candidates(posted, labels, star=False), "pairs")
    if not rest.isEmpty():
        more = written(confirmed(rest, shingles), "confirmed")
        if not more.isEmpty():
            labels = written(components(labels.select(F.col("key").alias("a"), F.col("component").alias("b")).union(more)), "labels")
    dropped(posted, star, shingles, rest)
    known = classes.select("key", "first", "copies").join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = known.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("classes"))
    member = written(joined(known, least, "component", "classes", classes.count()).select("key", "least", "copies"), "member")
    dropped(classes, links, labels)
    rows = sets.select("row", "doc_id", "n_shingles", "key")
    alone = rows.filter("key is null").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    found = joined(rows.filter("key is not null"), member, "key", "copies", rows.count())
    return found.select("row", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept")).union(alone)


def op3_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(documents(spark, sf_dir))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents of which one row of each component stays, whole; rows without a doc_id or with a repeated one count each by itself."""
    name = "_row"
    while name in map(str.lower, docs.columns):
        name = "_" + name
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    found = kept_rows(numbered.select(F.col(name).alias("row"), "doc_id", "text"))
    return numbered.join(found.filter("kept").select(F.col("row").alias(name)), name, "left_semi").select(docs.columns)


ORACLE_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n_shingles + q.n_shingles - common)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM reach r JOIN both_ways g ON r.b = g.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
"""
