"""Best-fit packing of token sequences under several limits at once.

``pieces`` turns every whole text into token ids (vocabulary file of the
``tokenizers`` library, one closing id after each text) and cuts only texts
that are longer than a sequence.  ``pack`` puts the pieces into sequences by
vector best-fit: a sequence has residual capacities for tokens, documents and
attention cost (the sum of the squared piece lengths).  Pieces come longest
first; each goes to the open sequence that satisfies *every* limit and has the
least weighted norm of what would be left (``rule="norm"``) or the largest
weighted dot-product of its demand with what is left (``rule="dot"``); a new
sequence is opened only if none can take it.

At scale: pieces are dealt out evenly (round robin, so no key can be hot) to
groups of about ``GROUP`` rows of a few numbers each; a group is one task's
work.  Sequences that stay under 15/16 full are opened again in further rounds:
they move as wholes, so that a group knows how many it had, and keeps them as
they were if packing anew does not save any.  A round is stored before the next
begins, so a lost executor repeats one round at most, on the same rows.

Words between white space are encoded once and remembered; the pattern of these
vocabularies never joins over white space.  Latin words are cut by the pattern
here and only new pieces go to the library's model; other words go through the
library whole.  A worker keeps two generations of words and drops the older
when the newer is full, which costs time only.  A text's ids are the joined
bytes of its words.

Defined cases: null or empty text: the closing id alone, one piece of length 1;
a piece above the attention limit, or limits under 1, raise; repeated rows and
null ids are packed like any other row, each for itself; other columns of the
input are kept (a column named like a result is replaced); ties go to the
sequence opened first; an empty table gives an empty result.  The white space
of the vocabulary's pattern is Unicode's; ``\\x1c-\\x1f`` are characters.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solstice.llm import words as W
from solstice.llm.graph import stored

#: Pieces packed together by one task.
GROUP = 1 << 15
#: The longest word that is remembered.
LONG_WORD = 64
#: Rounds that open sequences again, and the share of the tokens from which a sequence counts as full.
ROUNDS, FULL = 2, 15 / 16
#: Characters that str.split() takes for white space and the pattern does not.
_NOT_BLANK = re.compile("[\x1c-\x1f]")
#: Words of these characters are in normal form, and their lower case and classes have never changed.
_LATIN = re.compile("[\x00-\u024f]*")
# Fixed values of the vocabulary's file: its pattern, and the characters that its model writes for bytes.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weight of each in the choice."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)


class _Remembered(dict):
    """Values by key, two generations of at most ``size`` of them."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG_WORD:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Text -> bytes of its ids (little-endian, 32 bits each)."""

    def __init__(self, json: str, max_words: int = 1 << 19):
        from tokenizers import Tokenizer  # only workers need the library

        self.library = Tokenizer.from_str(json)
        self.library.encode_special_tokens = True  # their spelling in a text is text
        self.model = self.library.model
        self.pieces = _Remembered(self._piece, max_words // 2)
        self.words = _Remembered(self._word, max_words)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_SHOWN))])

    def _word(self, word: str) -> bytes:
        if _LATIN.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))
        return self.library_ids(word)

    def library_ids(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def text(self, text: str) -> bytes:
        if _NOT_BLANK.search(text):
            return self.library_ids(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_MADE: dict[str, Encoder] = {}


def _encoder(path: str, json: str) -> Encoder:
    """One per worker process."""
    if path not in _MADE:
        _MADE.clear()
        _MADE[path] = Encoder(json)
    return _MADE[path]


def _fields(df: DataFrame, drop: set[str], new: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n for n, _ in new}
    return T.StructType([f for f in df.schema.fields if f.name not in drop | names] + [T.StructField(n, t) for n, t in new])


def pieces(df: DataFrame, vocabulary: str, end_id: int, length: int = 4096, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of every row: the other columns, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""
    with open(vocabulary, encoding="utf-8") as f:
        json = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: its file's size
    new = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    new += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    out, step, closing = _fields(df, {text_col}, new), 4 * length, np.array([end_id], dtype="<u4").tobytes()
    kept = [f.name for f in out.fields[: len(out.fields) - len(new)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, json.value)
        for whole in batches:
            for b in W.slices(whole, text_col):
                row, piece, ids = [], [], []
                for i, text in enumerate(b.column(text_col).to_pylist()):
                    data = encoder.text(text or "") + closing
                    cuts = range(0, len(data), step)
                    row.extend([i] * len(cuts))
                    piece.extend(range(len(cuts)))
                    ids.extend(data[c : c + step] for c in cuts)
                size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                cols = [b.column(c).take(pa.array(row, pa.int64())) for c in kept]
                number = np.array(piece, dtype=np.int64)
                cols += [pa.array(number, pa.int32()), pa.array(number * length), pa.array(size), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), flat))
                yield pa.record_batch(cols, names=[*kept, *(n for n, _ in new)])

    return df.mapInArrow(W.giving_back(run), out)


def best_fit(sizes: np.ndarray, limits: Limits, rule: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence of each piece, offset of each piece, number of sequences) for lengths in falling order."""
    cap = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.float64)
    weight = np.array(limits.weights)[:, None]
    if cap.min() < 1 or (len(sizes) and (sizes[0] > cap[0] or float(sizes[0]) ** 2 > cap[2])):
        raise ValueError("a piece exceeds the limits of a sequence")
    where, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    left, name, count, made = np.empty((3, 1024)), np.empty(1024, dtype=np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        need = np.array([[n], [1.0], [float(n) * n]])
        rest = left[:, :count] - need
        fits = (rest >= 0).all(axis=0)
        if rule == "norm":
            value = ((rest / cap[:, None]) ** 2 * weight).sum(axis=0)
        else:
            value = -(left[:, :count] * need / (cap**2)[:, None] * weight).sum(axis=0)
        value[~fits] = math.inf
        k = int(value.argmin()) if count else -1
        if k < 0 or not fits[k]:
            if count == left.shape[1]:
                # Sequences that not even the shortest piece fits into are closed; then there is room, or room is made.
                live = (left[0, :count] >= sizes[-1]) & (left[1, :count] >= 1) & (left[2, :count] >= float(sizes[-1]) ** 2)
                count = int(live.sum())
                left[:, :count], name[:count] = left[:, : len(live)][:, live], name[: len(live)][live]
                if 2 * count > left.shape[1]:
                    left, name = np.concatenate((left, np.empty_like(left)), axis=1), np.concatenate((name, np.empty_like(name)))
            k, count = count, count + 1
            left[:, k], name[k], made = cap, made, made + 1
        where[i], offset[i] = name[k], cap[0] - left[0, k]
        left[:, k] -= need[:, 0]
    return where, offset, made


def _packed(df: DataFrame, limits: Limits, rule: str, turn: int, size_col: str, seq: str, offset: str, filled: str, group: int) -> DataFrame:
    """Every row with its sequence, its offset and the tokens of its sequence; partitions are packed ``group`` rows at a time."""
    new = [(seq, T.LongType()), (offset, T.LongType()), (filled, T.LongType())]
    out = _fields(df, set(), new)
    kept = [f.name for f in out.fields[:-3]]

    def one(t: pa.Table, base: int) -> tuple[pa.Table, int]:
        sizes = t.column(size_col).to_numpy()
        order = np.argsort(-sizes, kind="stable")
        where, at, made = best_fit(sizes[order], limits, rule)
        put = lambda x: (y := np.empty_like(x), y.__setitem__(order, x))[0]
        where, at = put(where), put(at)
        if turn:
            old = t.column(seq).to_numpy()
            names, number = np.unique(old, return_inverse=True)
            if made >= len(names):  # nothing gained: as it was
                where, at, made = number, t.column(offset).to_numpy(), len(names)
        tokens = np.bincount(where, weights=sizes, minlength=made).astype(np.int64)
        cols = [t.column(c) for c in kept] + [pa.array(base + where), pa.array(at), pa.array(tokens[where])]
        return pa.table(cols, names=[*kept, seq, offset, filled]), base + made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (turn << 58) + (TaskContext.get().partitionId() << 34)
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, group - n) if not turn else b  # later rounds keep sequences whole
                held, n, b = [*held, part], n + part.num_rows, b.slice(part.num_rows)
                if n >= group and not turn:
                    t, base = one(pa.Table.from_batches(held), base)
                    yield from t.to_batches()
                    held, n = [], 0
        if n:
            t, base = one(pa.Table.from_batches(held), base)
            yield from t.to_batches()

    return df.mapInArrow(run, out)


def pack(df: DataFrame, limits: Limits = Limits(), rule: str = "norm", size_col: str = "length",
         sequence_col: str = "sequence_id", offset_col: str = "offset", group: int = GROUP) -> DataFrame:
    """Every row of ``df`` with ``sequence_col`` and ``offset_col``: its place, gapless from 0 in each sequence."""
    filled = "filled"
    while filled in df.columns:
        filled += "_"
    work = stored(df.drop(sequence_col, offset_col), "pack")
    done = []
    for turn in range(ROUNDS + 1):
        parts = math.ceil(work.count() / group)
        if turn and (parts == 0 or (turn > 1 and parts == last)):
            break
        last = parts
        dealt = work.repartition(max(1, parts)) if not turn else work.repartition(max(1, parts), sequence_col)
        placed = stored(_packed(dealt, limits, rule, turn, size_col, sequence_col, offset_col, filled, group), "pack")
        open_ = F.col(filled) < int(FULL * limits.tokens)
        if turn == ROUNDS or parts <= 1:
            done.append(placed)
            work = None
            break
        done.append(placed.filter(~open_))
        work = placed.filter(open_)
    if work is not None:
        done.append(work)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop(filled)
