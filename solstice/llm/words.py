"""Vectorised words, word fingerprints and word-window fingerprints over Arrow text.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``.  UTF-8
never uses those bytes inside a longer character, so byte runs are exactly the
words ``[^\\x20\\x09-\\x0D]+`` of the text.  Everything is computed with numpy
over the raw Arrow buffers, a bounded slice of rows at a time.

Fingerprints are 64-bit polynomial hashes of bytes (then of words), mixed at
the end.  Two equal word sequences always have equal fingerprints.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is its own slice.
SLICE_BYTES = 4 << 20
#: Bytes hashed at once.
HASH_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Fixed odd multipliers and byte codes of the polynomial hashes.
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_P, HASH_BYTES)
_INV = _powers(np.uint64(pow(int(_P), -1, 1 << 64)), HASH_BYTES)


@dataclass
class Words:
    """Words of a slice of texts.  ``first[i]:first[i+1]`` are row i's words."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # byte offset of each row, then the end
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    first: np.ndarray  # word index of each row, then the end

    @property
    def rows(self) -> np.ndarray:
        """Row index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_large_binary(texts.type) and not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, dtype=np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = False, blank: np.ndarray = _SPACE) -> Words:
    """Split every text of the array; ``lower`` maps A-Z to a-z first; ``blank`` marks the bytes between words."""
    data, offsets = text_buffers(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(data, offsets, empty, empty, np.zeros(len(offsets), np.int64))
    inside = ~blank[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return Words(data, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of the bytes of each span; spans are in order and disjoint."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + HASH_BYTES, side="right")))
        hi = int(ends[j - 1])
        pw, inv = (_POW, _INV) if hi - lo <= HASH_BYTES else (_powers(_P, hi - lo), _INV)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * pw[: hi - lo], out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[s]) * inv[s]
        i = j
    return mix(out)


def word_hashes(w: Words) -> np.ndarray:
    return span_hashes(w.data, w.starts, w.ends)


def window_hashes(ids: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Fingerprint of every ``size`` consecutive ids (rows ignored): ``len - size + 1`` values.

    Polynomial windows of lengths 1, 2, 4, … are joined along the bits of ``size``.
    """
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done = np.zeros(n, dtype=np.uint64), 0
    block, length, power = ids * np.uint64(2 * seed + 1), 1, _Q
    while done < size:
        if size & length:
            out = out * power + block[done : done + n]
            done += length
        if done < size:
            block = block[:-length] * power + block[length:]
            power, length = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), length * 2
    return mix(out)


def valid_windows(first: np.ndarray, size: int) -> np.ndarray:
    """Mask over all ``total - size + 1`` window starts: the window lies in one row."""
    total = int(first[-1])
    n = total - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    stop = np.repeat(first[1:], np.diff(first))  # end of the row of each word
    return stop[:n] >= np.arange(n) + size


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have at most ``limit`` bytes together."""
    _, offsets = text_buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j


def joined(w: Words, keep: np.ndarray, row: int) -> bytes:
    """The kept words of one row joined by single spaces."""
    a, b = int(w.first[row]), int(w.first[row + 1])
    starts, ends = w.starts[a:b][keep[a:b]], w.ends[a:b][keep[a:b]]
    if len(starts) == 0:
        return b""
    # Neighbouring kept words separated by one space in the text form one piece.
    cut = np.flatnonzero((starts[1:] != ends[:-1] + 1) | (w.data[np.minimum(ends[:-1], len(w.data) - 1)] != 0x20))
    lo = np.concatenate(([starts[0]], starts[1:][cut]))
    hi = np.concatenate((ends[:-1][cut], [ends[-1]]))
    raw = w.data
    return b" ".join(raw[s:e].tobytes() for s, e in zip(lo.tolist(), hi.tolist()))


def giving_back(run: Callable) -> Callable:
    """A mapInArrow function that, when its input ends, returns freed memory to the system.

    Spark keeps Python workers for later tasks; without this they would hold
    their peak while the next stages need the executor's memory.
    """
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return wrapped


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
