"""Byte-level BPE: encode texts to token ids and decode ids to bytes, exactly.

A text is cut into pieces by the tokenizer's pattern and each piece is encoded
on its own.  The bytes of a piece are read as Latin-1 characters, so a
pyahocorasick automaton over the vocabulary finds, in one pass, the longest
token that starts at each byte.  The encoder goes from left to right, takes the
longest token that is *compatible* with the one before it and steps back to a
shorter prefix token (or the previous token) when none is; a byte offset that
led nowhere is never entered again, so the work is linear in the piece.

Two adjacent tokens are compatible when undoing their merges, latest first,
never meets a pair across the border that the merge order would have joined
earlier.  A sequence of pairwise compatible tokens is the one that the merges
give.  Compatibility is memoised.

Ranks are the merge order and the ids; a vocabulary token that its own merges
can't reach is used only where it is a whole piece, as rank files define it.

Each Python worker holds the vocabulary and two bounded memories (pieces,
compatible pairs); both are emptied when full, which costs time only.

Defined cases: null or empty text: no ids, no bytes; unknown ids in ``decode``
raise; other columns of the input are kept as they are (a column named like the
result is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from solstice.llm import words as W

#: Pieces and token pairs remembered by a worker.
MAX_PIECES = 1 << 18
MAX_PAIRS = 1 << 20
#: Longer pieces (in characters) are encoded each time.
LONG_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file (base64, blank, number)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Parts of a token after all merges of a rank under ``below`` (only for building tables)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Tables of one vocabulary, and the encoder of a piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values()) + 1
        self.token: list[bytes | None] = [None] * top
        self.left, self.right = list(range(top)), list(range(top))
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: list[int] = [-1] * top
        self.automaton = ahocorasick.Automaton()
        reach = {}
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            self.token[r] = t
            if len(t) > 1:
                parts = _merged(t, ranks, r)
                if len(parts) != 2:
                    continue
                a, b = ranks[parts[0]], ranks[parts[1]]
                self.left[r], self.right[r] = a, b
                self.joined[a, b] = r
            reach[t] = r
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        for t, r in reach.items():
            self.shorter[r] = next((reach[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reach), -1)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.token)  # joins across the border of a rank below this would have come first
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            # Undo the later of the two merges; a single byte can't be undone.
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def encode(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest, size = [-1] * n, [0] * n
        for end, (length, r) in self.automaton.iter(raw.decode("latin-1")):
            if length > size[end + 1 - length]:
                size[end + 1 - length], longest[end + 1 - length] = length, r
        open_, out, pos = bytearray(b"\x01") * (n + 1), [], 0
        token = longest[0]
        while pos < n or not open_[pos]:
            last = out[-1] if out else -1
            while token >= 0:
                end = pos + len(self.token[token])
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            else:  # a dead end: try the previous token's next shorter prefix
                if last < 0:
                    raise ValueError(f"the vocabulary does not cover {raw[:40]!r}")
                open_[pos] = 0
                out.pop()
                pos -= len(self.token[last])
                token = last
        return out


class _Pieces:
    """Ids of known pieces in flat arrays, so that a whole slice is put together by numpy."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat: list[int] = []
        self.start: list[int] = [0]

    def __missing_(self, piece: str) -> int:
        self.flat.extend(self.codec.encode(piece))
        self.start.append(len(self.flat))
        return len(self.start) - 2

    def numbers(self, pieces: list[str]) -> list[int]:
        get, out = self.number.get, []
        for p in pieces:
            k = get(p)
            if k is None:
                k = self.__missing_(p)
                if len(p) <= LONG_PIECE:
                    self.number[p] = k
            out.append(k)
        return out

    def encode(self, texts: list[str], find) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text's ids)."""
        if len(self.number) >= MAX_PIECES or len(self.start) >= 4 * MAX_PIECES:
            self.clear()
        found = [self.numbers(find(t)) for t in texts]
        which = np.fromiter((k for f in found for k in f), dtype=np.int64)
        start, flat = np.array(self.start, dtype=np.int64), np.array(self.flat, dtype=np.int32)
        length = np.diff(start)[which]
        ends = np.cumsum(length)
        ids = flat[np.repeat(start[which] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        pieces = np.cumsum([0] + [len(f) for f in found])
        return ids, np.concatenate(([0], ends))[pieces]


_MADE: dict = {}


def _codec(ranks_file: tuple[tuple[bytes, int], ...] | None, key: str) -> Codec:
    """One per worker process."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Codec(dict(ranks_file))
    return _MADE[key]


def _replaced(b: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    cols = {c: b.column(c) for c in b.schema.names if c != name}
    return pa.record_batch([*cols.values(), values], names=[*cols, name])


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind, True)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows of ``df`` with ``ids_col``: the token ids of ``text_col`` (array of int)."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(tuple(read_ranks(ranks_path).items()))  # a vocabulary: its file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, find = _Pieces(_codec(ranks.value, ranks_path)), regex.compile(pattern).findall
        for whole in batches:
            for b in W.slices(whole, text_col):
                ids, offsets = pieces.encode([t or "" for t in b.column(text_col).to_pylist()], find)
                yield _replaced(b, ids_col, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))

    return df.mapInArrow(run, _with(df, ids_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All rows of ``df`` with ``bytes_col``: the bytes of the tokens in ``ids_col`` (null: empty)."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(tuple(read_ranks(ranks_path).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {r: t for t, r in ranks.value}
        size = np.full(max(table) + 1, -1, dtype=np.int64)
        size[list(table)] = [len(t) for t in table.values()]
        start = np.zeros(len(size), dtype=np.int64)
        order = sorted(table)
        start[order] = np.cumsum([0] + [len(table[r]) for r in order[:-1]])
        flat = np.frombuffer(b"".join(table[r] for r in order), dtype=np.uint8)
        for whole in batches:
            lists = whole.column(ids_col)
            i = 0
            while i < whole.num_rows:  # a bounded number of ids at once
                offs = lists.offsets.to_numpy()
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + (1 << 20), side="right")) - 1)
                j = min(j, whole.num_rows)
                b = whole.slice(i, j - i)
                part = b.column(ids_col)
                ids = part.flatten().to_numpy().astype(np.int64)
                n = np.diff(offs[i : j + 1])
                if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or (size[ids] < 0).any()):
                    raise ValueError("an id outside the vocabulary")
                ends = np.cumsum(size[ids])
                raw = flat[np.repeat(start[ids] - (ends - size[ids]), size[ids]) + np.arange(int(ends[-1]) if len(ends) else 0)]
                edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
                out = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield _replaced(b, bytes_col, out)
                i = j

    return df.mapInArrow(run, _with(df, bytes_col, T.BinaryType()))
