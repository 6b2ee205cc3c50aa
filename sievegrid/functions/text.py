"""Column expressions on message text. Missing text is empty text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MODEL_TEXT_CHARS = 20_000

# Patterns of the masks and of cleaning.
EMAIL = r"(?i)(?<![A-Z0-9._%+\-])[A-Z0-9._%+\-]+@(?:[A-Z0-9-]+\.)+[A-Z0-9-]*[A-Z0-9](?![A-Z0-9-])"
URL = r"(?i)(?:https?://|ftp://|www\.)[^\s<>\"]+"
LONG_NUMBER = r"(?U)(?<!\w)\d{5,}(?!\w)"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TOKEN = r"(?U)\b\w{2,}\b"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def compatible(c: Column | str) -> Column:
    """NFKC by the ICU library that Spark carries, so rows stay in the JVM; ASCII texts are as they are."""
    t = text_of(c)
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))).otherwise(t)


def _tidied(t: Column) -> Column:
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, CONTROL, " "), r"[ \t\f\x0b]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


# Whether a text may hold what a pattern changes; most texts do not, and need not be read by it. Plain signs are searched for without a pattern.


def _untidy(t: Column) -> Column:
    """What _tidied() would change."""
    ends = F.substring(t, 1, 1).rlike(r"(?U)\s") | F.substring(t, -1, 1).rlike(r"(?U)\s")
    return reduce(Column.__or__, (F.contains(t, F.lit(x)) for x in ("  ", " \n", "\n ", "\n\n\n"))) | ends | t.rlike(r"[\x00-\x09\x0b-\x1f\x7f]")


def _may_link(t: Column) -> Column:
    return F.contains(t, F.lit("://")) | t.rlike(r"[wW][wW][wW]\.")


def normalized(c: Column | str) -> Column:
    """Compatible characters, one kind of newline, no control signs, single blanks, at most two newlines in a row, no blanks at the ends."""
    return _tidied(compatible(c))


def with_masks(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """For each name → text a column `name` with addresses, then links, then long numbers replaced, and name_emails, name_urls, name_numbers that count them.

    The steps are columns of their own, so that each is computed once.
    """
    names = list(columns)
    where = lambda found, changed, n: F.when(found, changed).otherwise(F.col(n))
    df = df.withColumns({f"_{n}c": compatible(c) for n, c in columns.items()})
    df = df.withColumns({f"_{n}0": where(_untidy(F.col(f"_{n}c")), _tidied(F.col(f"_{n}c")), f"_{n}c") for n in names})
    df = df.withColumns({f"_{n}1": where(F.contains(F.col(f"_{n}0"), F.lit("@")), F.regexp_replace(f"_{n}0", EMAIL, "<EMAIL>"), f"_{n}0") for n in names})
    df = df.withColumns({f"_{n}2": where(_may_link(F.col(f"_{n}1")), F.regexp_replace(f"_{n}1", URL, "<URL>"), f"_{n}1") for n in names})
    found = {f"{n}_{kind}": F.regexp_count(f"_{n}{k}", F.lit(pattern)) for n in names for k, (kind, pattern) in enumerate((("emails", EMAIL), ("urls", URL), ("numbers", LONG_NUMBER)))}
    out = df.withColumns(found | {n: where(F.col(f"_{n}2").rlike(r"\p{Nd}{5}"), F.regexp_replace(f"_{n}2", LONG_NUMBER, "<NUMBER>"), f"_{n}2") for n in names})
    return out.drop(*(f"_{n}{k}" for n in names for k in "c012"))


def with_model_text(df: DataFrame, subject: str = "subject", body: str = "text_body", limit: int = MODEL_TEXT_CHARS) -> DataFrame:
    """Adds clean_subject, clean_body, model_text (cut at limit), original_chars, cleaned_chars, emails, urls, numbers, truncated and parse_warnings."""
    df = with_masks(df, {"clean_subject": subject, "clean_body": body})
    df = df.withColumn("_whole", F.concat("clean_subject", F.lit("\n"), "clean_body"))
    truncated = F.length("_whole") > limit
    add = lambda k: F.col(f"clean_subject_{k}") + F.col(f"clean_body_{k}")
    out = df.withColumns(
        {
            "model_text": F.substring("_whole", 1, limit),
            "original_chars": (F.length(text_of(subject)) + F.length(text_of(body))).cast("long"),
            "cleaned_chars": F.least(F.length("_whole"), F.lit(limit)),
            "emails": add("emails"), "urls": add("urls"), "numbers": add("numbers"), "truncated": truncated,
            "parse_warnings": F.array_compact(F.array(F.when(F.col("clean_subject") == "", "empty_subject"), F.when(F.col("clean_body") == "", "empty_text_body"), F.when(truncated, "model_text_truncated"))),
        }
    )
    return out.drop("_whole", *(f"clean_{c}_{k}" for c in ("subject", "body") for k in ("emails", "urls", "numbers")))


def char_text(subject: Column | str, body: Column | str, limit: int = MODEL_TEXT_CHARS) -> Column:
    """The unmasked view that character models read."""
    t = F.regexp_replace(compatible(F.concat(text_of(subject), F.lit("\n"), text_of(body))), r"\r\n?", "\n")
    return F.substring(F.regexp_replace(t, CONTROL, " "), 1, limit)


def fingerprint(c: Column | str) -> Column:
    return F.sha2(text_of(c), 256)


def pair_fingerprint(subject: Column | str, body: Column | str) -> Column:
    return F.sha2(F.concat(text_of(subject), F.lit("\n"), text_of(body)), 256)


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns' JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(TOKEN), F.lit(0))


#: Words that a worker gathers at once.
WORDS_AT_ONCE = 100_000


def word_slices(at_once: int) -> Callable[[pa.ListArray], Iterator[tuple[int, int, pa.Array, np.ndarray]]]:
    """Of a column of words: first row, end, words and their numbers in each row, of parts of at most at_once words, or of one row. The function needs no module of this library where it runs."""

    def slices(lists):
        ends, flat, at = np.append(0, np.cumsum(lists.value_lengths().to_numpy())), lists.flatten(), 0
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + at_once, "right")) - 1)
            yield at, to, flat.slice(ends[at], ends[to] - ends[at]), np.diff(ends[at : to + 1])
            at = to

    return slices


def simhash64(df: DataFrame, row_id: str, column: str, *more: str) -> DataFrame:
    """row_id, simhash, and the columns of more: 64 token votes as 16 hex digits, from the first 16 digits of each token's MD5; a tie sets the bit, so a text without tokens has all.

    The votes of a row are counted where its text is, and nothing is shuffled; rows of the same text have the same hash. A token of a part of the rows is hashed once.
    """
    rows, at_once = df.select(row_id, *more, tokens(column).alias("_words")), WORDS_AT_ONCE
    slices = word_slices(at_once)

    def prints(batches):
        for batch in batches:
            for at, to, words, lengths in slices(batch.column("_words")):
                coded = words.dictionary_encode()
                digests = b"".join(hashlib.md5(w, usedforsecurity=False).digest()[:8] for w in coded.dictionary.cast(pa.binary()).to_pylist())
                bits, code = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1), coded.indices.to_numpy()
                if len(code) > at_once:  # one row
                    sums = sum(bits[code[k : k + at_once]].sum(axis=0, dtype=np.int64, keepdims=True) for k in range(0, len(code), at_once))
                else:
                    some, sums = np.flatnonzero(lengths), np.zeros((to - at, 64), np.int64)
                    if len(some):
                        sums[some] = np.add.reduceat(bits[code], (np.cumsum(lengths) - lengths)[some], axis=0, dtype=np.int32)
                votes = 2 * sums >= lengths[:, None]
                found = np.packbits(votes, axis=1).tobytes().hex()
                simhash = pa.array([found[k : k + 16] for k in range(0, len(found), 16)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(row_id).slice(at, to - at), simhash, *(batch.column(c).slice(at, to - at) for c in more)], [row_id, "simhash", *more])

    kinds = df.select(row_id, *more).schema.fields
    return rows.mapInArrow(prints, StructType([kinds[0], *StructType.fromDDL("simhash string").fields, *kinds[1:]]))


def clipped(c: Column | str, limit: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " ")), 1, limit)


def iso_z(c: Column | str) -> Column:
    """UTC time with milliseconds and Z; the session's zone is UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def length_band(c: Column | str) -> Column:
    n = F.length(text_of(c))
    return F.when(n < 500, "short").when(n < 5000, "medium").otherwise("long")


def probability_band(p: Column | str) -> Column:
    low = F.least(F.floor(F.col(p) * 10 if isinstance(p, str) else p * 10), F.lit(9)) / 10
    return F.format_string("%.1f-%.1f", low, low + 0.1)


def placeholder_stats(c: Column | str, blank: int = 0) -> Column:
    """blank: the tokens of a text without any. Splitting such a text at blanks, as SQL does, gives one."""
    t = text_of(c)
    count = lambda w: ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("int")
    words = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.struct(
        F.when(words == "", blank).otherwise(F.size(F.split(words, " "))).alias("tokens"),
        count("<EMAIL>").alias("emails"), count("<URL>").alias("urls"), count("<NUMBER>").alias("numbers"), t.rlike(r"[^\x00-\x7F]").alias("non_ascii"),
    )


def hash_split(*fields: Column | str) -> Column:
    """train for 6 of 10 hash buckets of the joined fields, valid and test for 2 each."""
    bucket = F.conv(F.substring(F.sha2(F.concat_ws("|", *(text_of(f) for f in fields)), 256), 1, 8), 16, 10).cast("long") % 10
    return F.when(bucket <= 5, "train").when(bucket <= 7, "valid").otherwise("test")
