r"""Fill-in-the-middle transformation by content-defined chunk memoization.

A text is cut into units, `[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`: a unit ends where a word ends, and blanks at
the end of the text are one more. Two cuts between units give a prefix, a middle and a suffix, which the output reorders.

Cuts are found on chunks. A rolling hash over the last bytes decides where chunks end, so texts that share a passage share
its chunks wherever it stands. A worker keeps, under the bytes of a chunk (the whole content is compared, not a hash of it), a summary:
its code points, the word ends inside it and whether it begins and ends with a blank. What the summaries of a text leave open is only
whether a word ends at a border, which the blanks on its two sides tell; running sums of the counts then name the chunk
that holds a cut, and its summary the place. Memory kept is bounded and never changes a result: chunks that were
forgotten are summarised again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.shared import documents
from sievegrid.llm.textbytes import SPACE, U64, mix64, packed, slices, tidy

SEED, PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes the rolling hash sees; a chunk ends where its lowest bits are all zero, or before it grows too long.
ROLL, CHUNK_BITS, LONGEST = 32, 10, 8192
#: Bytes of chunks (and summaries) that a worker keeps before it starts anew.
KEPT_BYTES = 48 << 20

_GEAR = mix64(np.arange(1, 257, dtype=U64) * U64(0x9FB21C651E98DF25))
_FOLLOWS = np.zeros(256, dtype=bool)
_FOLLOWS[128:192] = True


def chunk_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text that isn't empty, after ROLL bytes that the hash chooses, and every LONGEST bytes at least; never inside a code point."""
    if not len(buf):
        return np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros(1, U64), _GEAR[buf] * (np.arange(len(buf)).astype(U64) * U64(2) + U64(1))])
    np.cumsum(sums, out=sums)
    # the weights grow by 2 a byte: taking off the plain sum times the place makes the hash depend on the bytes alone
    plain = np.concatenate([np.zeros(1, U64), _GEAR[buf]])
    np.cumsum(plain, out=plain)
    at = np.arange(ROLL, len(buf))
    seen = (sums[at] - sums[at - ROLL]) - (plain[at] - plain[at - ROLL]) * ((at - ROLL).astype(U64) * U64(2))
    cut = at[(mix64(seen) & U64((1 << CHUNK_BITS) - 1)) == 0]
    begin = off[:-1][off[1:] > off[:-1]]
    cut = cut[cut - ROLL >= begin[np.searchsorted(begin, cut, side="right") - 1]]  # the bytes it saw are of one text
    cut = cut[~_FOLLOWS[buf[cut]]]
    starts = np.union1d(begin, cut)
    size = np.diff(np.append(starts, len(buf)))
    if (size > LONGEST).any():
        more = np.concatenate([np.arange(s, s + n, LONGEST) for s, n in zip(starts[size > LONGEST], size[size > LONGEST], strict=True)])
        for _ in range(3):
            more = more - _FOLLOWS[buf[more]]
        starts = np.union1d(starts, more)
    return starts


class Memo:
    """Summaries of chunks, by their bytes: (code points, first is blank, last is blank, word ends inside in bytes, the same in code points)."""

    _own: Memo | None = None

    def __init__(self, most: int = KEPT_BYTES):
        self.most, self.size, self.of = most, 0, {}

    @classmethod
    def mine(cls) -> Memo:
        """That of this Python worker."""
        cls._own = cls._own or cls()
        return cls._own

    def summaries(self, chunks: list[bytes]) -> list[tuple]:
        known = self.of
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if new:
            fresh = dict(zip(new, _summarise(new), strict=True))
            self.size += sum(len(c) + 4 * len(s[3]) + 500 for c, s in fresh.items())
            if self.size > self.most:
                out = [known[c] if c in known else fresh[c] for c in chunks]
                self.of, self.size = {}, 0
                return out
            known.update(fresh)
        return [known[c] for c in chunks]


def _summarise(chunks: list[bytes]) -> list[tuple]:
    buf = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
    blank = SPACE[buf]
    points = np.concatenate([[0], np.cumsum(~_FOLLOWS[buf])])
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    which = np.searchsorted(off, ends, side="right") - 1
    inside = ends > off[which]
    ends, which = ends[inside], which[inside]
    in_bytes, in_points = (ends - off[which]).astype(np.uint16), (points[ends] - points[off[which]]).astype(np.uint16)
    cut = np.searchsorted(which, np.arange(len(chunks) + 1)).tolist()
    n, first, last = np.diff(points[off]).tolist(), blank[off[:-1]].tolist(), blank[off[1:] - 1].tolist()
    return [(n[k], first[k], last[k], in_bytes[a:b].copy(), in_points[a:b].copy()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


@dataclass
class Units:
    """Units of a column of texts, known by the chunks they stand in."""

    n: np.ndarray  # of each text
    first: np.ndarray  # chunk of each text, and one entry more
    begin: np.ndarray  # byte of each chunk, and one entry more
    points: np.ndarray  # code points before each chunk, and one entry more
    ends: np.ndarray  # word ends before each chunk's own, and one entry more; an end at a chunk's last byte is the chunk's own
    summary: list[tuple]

    def place(self, text: int, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units of a text."""
        a, b = int(self.first[text]), int(self.first[text + 1])
        if k == 0 or a == b:
            return 0, 0
        if k >= self.n[text]:
            return int(self.begin[b] - self.begin[a]), int(self.points[b] - self.points[a])
        wanted = int(self.ends[a]) + k
        c = int(np.searchsorted(self.ends[a + 1 : b + 1], wanted)) + a
        inside, here = wanted - int(self.ends[c]) - 1, self.summary[c]
        if inside < len(here[3]):
            return int(self.begin[c] - self.begin[a]) + int(here[3][inside]), int(self.points[c] - self.points[a]) + int(here[4][inside])
        return int(self.begin[c + 1] - self.begin[a]), int(self.points[c + 1] - self.points[a])


def units(buf: np.ndarray, off: np.ndarray, memo: Memo) -> Units:
    starts = chunk_starts(buf, off)
    begin = np.append(starts, len(buf))
    whole = buf.tobytes()
    summary = memo.summaries([whole[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
    first = np.searchsorted(starts, off)
    inside = np.array([len(s[3]) for s in summary], dtype=np.int64)
    opens, closes = np.array([s[1] for s in summary], dtype=bool), np.array([s[2] for s in summary], dtype=bool)
    final = np.zeros(len(starts), dtype=bool)
    final[first[1:][first[1:] > first[:-1]] - 1] = True
    at_border = ~closes & (final | np.append(opens[1:], True)[: len(starts)])
    ends = np.concatenate([[0], np.cumsum(inside + at_border)])
    n = ends[first[1:]] - ends[first[:-1]]
    full = first[1:] > first[:-1]
    n[full] += closes[first[1:][full] - 1]  # blanks at the end of a text are a unit
    return Units(n, first, begin, np.concatenate([[0], np.cumsum([s[0] for s in summary], dtype=np.int64)]), ends, summary)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the document's id alone; a missing id counts as the empty string."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12))


def transformed(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs (doc_id, text; other columns are left alone).

    form: plain for texts that are null (read as empty), empty or hold a marker, and for all but `percent` in a hundred of the others;
    of these `spm_percent` in a hundred are spm (suffix first), the others psm. Which they are, and where the cuts are, follows from
    the seed and doc_id alone, so rows that share a doc_id share the draws, and rows without one too. prefix_chars and
    middle_chars are null for plain texts. An empty table gives no rows. Very long texts are read whole.
    """

    def transform(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b in slices(batch.column(1)):
                column = batch.column(1).slice(a, b - a)
                if column.null_count:
                    column = pc.fill_null(column, "")
                buf, off = packed(column)
                marked = np.zeros(len(column), dtype=bool)
                for m in (PREFIX, SUFFIX, MIDDLE):
                    marked |= pc.match_substring(column, m).to_numpy(zero_copy_only=False)
                found, whole, at = units(buf, off, Memo.mine()), memoryview(buf), off.tolist()
                out: dict[str, list] = {"form": [], "prefix_chars": [], "middle_chars": [], "output": []}
                for i, doc_id in enumerate(ids[a:b]):
                    h1, h2, h3, h4 = draws(doc_id, seed)
                    text, n = whole[at[i] : at[i + 1]], int(found.n[i])
                    if not len(text) or marked[i] or h3 % 100 >= percent:
                        row = ("plain", None, None, bytes(text))
                    else:
                        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                        (x, p), (y, m) = found.place(i, low), found.place(i, high)
                        spm = h4 % 100 < spm_percent
                        parts = [SUFFIX.encode(), text[y:], PREFIX.encode(), text[:x]] if spm else [PREFIX.encode(), text[:x], SUFFIX.encode(), text[y:]]
                        row = ("spm" if spm else "psm", p, m - p, b"".join([*parts, MIDDLE.encode(), text[x:y]]))
                    for column_of, item in zip(out.values(), row, strict=True):
                        column_of.append(item)
                outputs = pa.array(out["output"], pa.binary()).cast(pa.string())
                own = [batch.column(0).slice(a, b - a), pa.array(found.n), pa.array(out["form"]), pa.array(out["prefix_chars"], pa.int64()), pa.array(out["middle_chars"], pa.int64()), outputs]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(transform), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. Each marker stands once in an output that isn't plain, so the parts lie between them."""

    def part(after: str, before: str | None) -> Column:
        return F.substring_index(F.substring_index(output, before, 1) if before else output, after, -1)

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all transformed documents and of the texts restored from them."""
    rows = transformed(documents(spark, sf_dir))
    output, back = F.sha2(F.col("output").cast("binary"), 256), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output_sha256"), back.alias("restored_sha256"))


ORACLE_OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
k AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(x || y || z) AS restored_sha256
FROM p
"""
