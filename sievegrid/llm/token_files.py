"""Token ids in flat binary files with 64-bit document offsets.

A folder holds for each range partition k of the documents, in ascending doc_id order:

* part-k.bin: all token ids as little-endian unsigned integers, one document after the other; 16 bits wide where
  the vocabulary fits, else 32
* part-k.off: n + 1 little-endian unsigned 64-bit offsets of the documents, counted from the part's first id
* part-k.doc: n little-endian signed 64-bit doc_ids, then n bytes that are 1 where doc_id is not null

Readers map the files into memory. A part's base in the whole corpus is the prefix sum of the sizes of the
parts before it. Each task writes under a name of its own attempt and renames when all is there, so a lost
executor or a second attempt leaves whole files only. The folder must be one that all executors see.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.shared import documents, new_path
from sievegrid.llm.textbytes import slices, tidy
from sievegrid.llm.tokens import ENCODE_BYTES, END_ID, Encoder, tokenizer_path, with_end


@dataclass
class TokenFiles:
    """Where the files are, and for each part (first document, first id) in the whole corpus, from prefix sums."""

    folder: str
    bases: list[tuple[int, int]]
    width: str


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END_ID) -> TokenFiles:
    """Encode doc_id, text (null: empty) and write the files. Rows without doc_id come first; equal doc_ids follow each other by text."""
    tokenizer = tokenizer or tokenizer_path()
    width = "<u2" if max(Encoder.of(tokenizer).library.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"

    def write_part(batches):
        from pyspark import TaskContext

        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        context = TaskContext.get()
        name, own = f"{at}/part-{context.partitionId():06d}", f"{at}/.attempt-{context.taskAttemptId()}"
        encoder, offsets, ids, there, total = Encoder.of(tokenizer), [np.zeros(1, np.int64)], [], [], 0
        with store.open_output_stream(f"{own}.bin") as out:
            for batch in batches:
                texts, keys = batch.column(1), batch.column(0)
                for a, b in slices(texts, ENCODE_BYTES):
                    flat, off = with_end(*encoder.ids(texts.slice(a, b - a)), end)
                    out.write(flat.astype(width).tobytes())
                    offsets.append(off[1:] + total)
                    total += len(flat)
                there.append(np.asarray(keys.is_valid()).astype(np.uint8))
                ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        off = np.concatenate(offsets)
        for kind, data in (("off", off.astype("<u8").tobytes()), ("doc", b"".join(x.tobytes() for x in [*ids, *there]))):
            with store.open_output_stream(f"{own}.{kind}") as out:
                out.write(data)
        for kind in ("bin", "off", "doc"):
            store.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "docs": [len(off) - 1], "tokens": [total]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(ordered.mapInArrow(tidy(write_part), "part long, docs long, tokens long").collect())  # a row for each task
    sizes = {r.part: (r.docs, r.tokens) for r in parts}
    bases, docs_before, ids_before = [], 0, 0
    for k in range(max(sizes, default=-1) + 1):
        bases.append((docs_before, ids_before))
        n, m = sizes.get(k, (0, 0))
        docs_before, ids_before = docs_before + n, ids_before + m
    return TokenFiles(folder, bases, width)


def read_part(folder: str, k: int, width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc_ids, doc_id is there) of a part; ids are mapped, not read, where the folder is a mounted one."""
    from pyarrow import fs

    store, at = _store(folder)
    arrays = []
    for kind, dtype in (("bin", width), ("off", "<u8"), ("doc", np.uint8)):
        path = f"{at}/part-{k:06d}.{kind}"
        if isinstance(store, fs.LocalFileSystem):
            buffer = pa.memory_map(path).read_buffer()
        else:
            with store.open_input_file(path) as file:
                buffer = file.read_buffer()
        arrays.append(np.frombuffer(buffer, dtype=dtype))
    ids, off, doc = arrays
    n = len(off) - 1
    return ids, off.astype(np.int64), doc[: 8 * n].view("<i8"), doc[8 * n :].astype(bool)


def read(spark: SparkSession, files: TokenFiles, per_document, schema: str) -> DataFrame:
    """Rows that per_document(doc_ids, there, first id of each document, ids, offsets) gives as a dict of columns, for each part."""
    folder, bases, width = files.folder, files.bases, files.width

    def read_parts(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, off, doc, there = read_part(folder, k, width)
                if len(doc):
                    yield pa.RecordBatch.from_pydict(per_document(doc, there, off[:-1] + bases[k][1], ids, off))

    n = max(1, len(bases))
    return spark.range(0, len(bases), 1, n).mapInArrow(read_parts, schema)


def document_digests(doc, there, start, ids, off) -> dict:
    """doc_id, start, n_tokens and the crc32 of each document's ids as 32-bit integers."""
    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return {"doc_id": pa.array(doc, mask=~there), "start": pa.array(start), "n_tokens": pa.array(np.diff(off)), "ids_crc32": pa.array(crc, pa.int64())}


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to token files and back: doc_id, start, n_tokens, ids_crc32, read from the files."""
    files = write(documents(spark, sf_dir), new_path(spark, "token-files"))
    return read(spark, files, document_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
