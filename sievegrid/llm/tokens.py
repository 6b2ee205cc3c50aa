"""Byte-level BPE token ids of whole Arrow columns, by the tokenizers library.

The library encodes each distinct pre-token once per worker; texts are cut into pre-tokens by array work on
their bytes. The cut follows the byte-level pattern for letters, digits, blanks and other ASCII signs. A text
with an apostrophe, a control character, the text of a special token or a letter outside Latin blocks goes
to the library whole, so that the ids are always the library's own.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from sievegrid.llm.textbytes import packed, slices, span_hashes

END_ID = 2
#: Pre-tokens whose ids a worker keeps; with more it starts anew.
MOST_KEPT = 1_000_000
#: Text that is encoded at once; its new pre-tokens are learnt in one call.
ENCODE_BYTES = 1 << 19

_LETTER, _DIGIT, _BLANK, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
#: Bytes that send a text to the library whole: control signs, apostrophe, leading bytes beyond Latin-1 letters and Latin Extended-A.
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(0, 9), *range(14, 32), 0x27, 0x7F, 0xC2, *range(0xC6, 0x100)]] = True


def _cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens."""
    kind = _KIND[buf]
    first = np.zeros(len(buf), dtype=bool)
    first[off[:-1][off[1:] > off[:-1]]] = True
    change = np.empty(len(buf), dtype=bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    blank = kind == _BLANK
    after = np.zeros(len(buf), dtype=bool)  # not blank, and a blank of the same text comes before
    after[1:] = blank[:-1] & ~blank[1:]
    after &= ~first
    starts = first | (change & ~after)
    at = np.flatnonzero(after)
    starts[at - 1] = True
    starts[at[buf[at - 1] != 0x20]] = True
    return np.flatnonzero(starts)


class Encoder:
    """ids(column) → (flat uint32 ids, offsets of the rows). path: a tokenizers file."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _forget(self) -> None:
        #: Sorted hashes of the pre-tokens met so far, and for each the place and number of its ids in `flat`.
        self.known = np.zeros(0, dtype=np.uint64)
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        groups = [texts[k : k + 500] for k in range(0, len(texts), 500)]
        encoded = self.library.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in encoded])
        sizes = np.concatenate([np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(g)) for e, g in zip(encoded, groups, strict=True)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.used += len(ids)

    def _plain(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts = _cuts(buf, off)
        ends = np.append(starts[1:], len(buf))
        hashes, where, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > MOST_KEPT:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        new[at < len(self.known)] = self.known[at[at < len(self.known)]] != hashes[at < len(self.known)]
        if new.any():
            whole = buf.tobytes()
            first = where[new]
            self._learn(hashes[new], [whole[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        slots = np.searchsorted(self.known, hashes)[inverse]
        sizes = self.size[slots]
        to = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[slots] - (to - sizes), sizes) + np.arange(to[-1])]
        return ids, np.concatenate([[0], to])[np.searchsorted(starts, off)]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for a, b in slices(column, ENCODE_BYTES):
            part = column.slice(a, b - a)
            buf, off = packed(part)
            odd = np.add.reduceat(np.append(_ODD[buf], False).astype(np.int32), off[:-1]) * (off[1:] > off[:-1]) > 0
            cross = (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))  # signs among the Latin-1 letters
            odd[np.searchsorted(off, np.flatnonzero(cross), side="right") - 1] = True
            whole = buf.tobytes()
            for s in self.special:
                at = whole.find(s)
                while at >= 0:
                    odd[np.searchsorted(off, at, side="right") - 1] = True
                    at = whole.find(s, at + 1)
            if not odd.any():
                ids, at = self._plain(buf, off)
                flat.append(ids)
                sizes.append(np.diff(at))
                continue
            for i in range(len(odd)):
                text = buf[off[i] : off[i + 1]]
                ids = np.array(self.library.encode(text.tobytes().decode(), add_special_tokens=False).ids, dtype=np.uint32) if odd[i] else self._plain(text, np.array([0, len(text)]))[0]
                flat.append(ids)
                sizes.append(np.array([len(ids)], dtype=np.int64))
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), np.concatenate([[0], *([np.cumsum(np.concatenate(sizes))] if sizes else [])]).astype(np.int64)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(ids: np.ndarray, off: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each document."""
    n = len(off) - 1
    out = np.full(len(ids) + n, end, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
    return out, off + np.arange(n + 1)


__all__ = ["ENCODE_BYTES", "END_ID", "Encoder", "tokenizer_path", "with_end"]
