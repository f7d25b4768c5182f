"""Vectorised text kernels that run inside Arrow map tasks (numpy only).

A batch is handled in pieces of about ``PIECE_BYTES`` of UTF-8 (or one text,
if it is longer), so memory in a task follows the piece and not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

#: Byte classes. Continuation bytes and all other bytes >= 0x80 belong to
#: non-ASCII code points.
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WHITESPACE = ~WHITESPACE
#: Letters and digits of ASCII, and every non-ASCII code point.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection with good avalanche)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of n + 1) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES):
    """Row ranges (first, last) of about ``size`` bytes, one row at least."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def split_words(data: np.ndarray, doc_off: np.ndarray, word_byte: np.ndarray):
    """Start and end byte of every word, and the n + 1 word offsets of the texts."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(doc_off), np.int64)
    w = word_byte[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[doc_off] = True
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, doc_off)


class WordHasher:
    """64-bit hashes of byte ranges from one prefix sum over a piece: with
    c = cumsum(byte[i] * base**i), a range hashes to (c[end] - c[start]) / base**start,
    all modulo 2**64, so equal words hash alike wherever they stand."""

    def __init__(self):
        self.power = self.inverse = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, PIECE_BYTES + 1)
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("power", _BASE), ("inverse", inv)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=c[1:])
        h = (c[ends] - c[starts]) * self.inverse[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * _M2))


def word_docs(doc_words: np.ndarray) -> np.ndarray:
    """Text number of every word."""
    return np.repeat(np.arange(len(doc_words) - 1), np.diff(doc_words))


def kgrams(h: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside one text, and the word each starts at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * _BASE + h[j:j + n]
    at = np.flatnonzero(docs[:n] == docs[k - 1:])
    return mix(acc[at]), at


def before(flags: np.ndarray) -> np.ndarray:
    """Prefix counts with a leading 0."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def starts_code_point(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def repeated_words(h: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Flags of the words inside a window of words that its text holds twice or more."""
    g, at = kgrams(h, docs, window)
    if len(g) == 0:
        return np.zeros(len(h), bool)
    with np.errstate(over="ignore"):
        key = g ^ mix(docs[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.zeros(len(h), bool)
    starts[at[twice]] = True
    c, n = before(starts), np.arange(len(h))
    return c[n + 1] > c[np.maximum(n - window + 1, 0)]
