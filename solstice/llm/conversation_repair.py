"""Conversation structure repair: the cheapest edits that make turns alternate.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.
Edits, by their initials: Keep a row (0), Rerole it to user or assistant (3),
Delete it (4; the only choice for blank and duplicate rows), Insert an
empty-text user or assistant row anywhere (3).  A truncated row that stays adds
3.  Of the cheapest repairs the one whose initials are ASCII-least is the
answer.

Method: iterative-deepening A*.  A state is the row reached and what the roles
so far allow next.  Depth-first search tries the edits in ASCII order under a
bound on the cost; the lower bound of the rest is what its faulty rows must
cost.  A state that fails keeps the cost it would need at least (transposition
table), so it is not entered again under a smaller budget, and the start's own
value is the next bound.  The first accepting path is the answer: the bound is
then the least cost, and no ASCII-smaller path was accepted.

Long conversations are searched in blocks of ``BLOCK`` rows: for each state a
block may begin in, the search gives the best edits to each state it may end
in, and these are joined block by block.  Ends that can't win any more are
dropped; edits on which the others agree are final, and their rows leave memory.  The joined answer is the whole
search's: of paths that meet in a state, only the cheapest and ASCII-least can
be part of it.

At scale: one shuffle, by conversation.  Duplicates are numbered by a window in
the same partitioning, rows are sorted by turn and pass through the task as a
stream, so a conversation of any length holds a block of texts (both sorts
spill) and its edits, a byte a row.  A conversation is not split over tasks:
its audit is one value and its digest reads its texts in order, whoever sorts
them.

Defined cases: a null role or text is one space (so the text is blank); a null
turn comes first; rows of one turn go by role, then text; rows with a null
conversation id form one conversation; repeated rows are duplicates; turns that
span more than a long saturate ``gaps``; a conversation that only has rows with
``present`` false or null has zeros, an empty audit and no rows; other columns
of the input are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import deque
from collections.abc import Callable, Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from solstice.llm import words as W

#: Rows searched at once.
BLOCK = 96
#: Rows of an output batch.
BATCH = 1024

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = {"su", "ua", "au"}

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_INITIAL = {USER: "u", ASSISTANT: "a"}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTING = frozenset((START, ASSISTANT))
#: What the rest can cost more from a state than from the assistant state, and from the assistant state than from it:
#: an insertion, two of them at the end, a deleted system row.
_DEARER = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
_CHEAPER = {START: DELETE, SYSTEM: 0, USER: INSERT, ASSISTANT: 0}

Code = tuple[str, bool, bool]  # initial of the role, has to go, truncated


def moves(codes: list[Code], i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, next row, next state, cost) of every edit that can lead to a legal end, in ASCII order."""
    follows = _FOLLOWS[q]
    if i < len(codes):
        yield "D", i + 1, q, DELETE
    yield "I", i, follows, INSERT
    if i < len(codes):
        initial, goes, truncated = codes[i]
        if not goes:
            more = TRUNCATED if truncated else 0
            if initial == _INITIAL[follows]:
                yield "K", i + 1, follows, KEEP + more
            else:
                if initial == "s" and q == START:
                    yield "K", i + 1, SYSTEM, KEEP + more
                yield "R", i + 1, follows, REROLE + more


def search(codes: list[Code], start: int, goals: frozenset[int]) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then ASCII-least path from ``start`` over all rows to one of ``goals``; None: no path."""
    n = len(codes)
    least, system = [0] * (n + 1), [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, goes, truncated = codes[i]
        least[i] = least[i + 1] + (DELETE if goes else min(TRUNCATED, DELETE) if truncated else 0)
        system[i] = system[i + 1] or (initial == "s" and not goes)
    open_end = bool(goals & {USER, ASSISTANT})
    need: dict[tuple[int, int], float] = {}

    def lower(i: int, q: int) -> float:
        known = need.get((i, q))
        if known is None:
            can = open_end or q in goals or (q == START and SYSTEM in goals and system[i])
            known = need[i, q] = least[i] if can else inf
        return known

    path: list[str] = []

    def reach(i: int, q: int, budget: float) -> bool:
        if i == n and q in goals:
            return True
        best = inf
        for edit, j, p, cost in moves(codes, i, q):
            if cost + lower(j, p) <= budget:
                path.append(edit)
                if reach(j, p, budget - cost):
                    return True
                path.pop()
            best = min(best, cost + lower(j, p))
        need[i, q] = best
        return False

    bound = lower(0, start)
    while bound < inf and not reach(0, start, bound):
        bound = need[0, start]
    return None if bound == inf else (int(bound), "".join(path))


class Conversation:
    """Takes the rows of one conversation in order, hands the repaired rows to ``emit(edit, role, text)`` as they become final."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit, self.audit = emit, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None
        self.state, self.rows, self.block = START, deque(), []
        self.paths: dict[int, tuple[int, str]] = {START: (0, "")}
        self.cost = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.high:  # turns come in order
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        initial, seen = role[:1], text.strip(BLANKS)
        if self.before is not None and self.before + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = initial
        blank, truncated = not seen, bool(seen) and seen[-1] not in ".!?"
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += truncated and not again
        if len(self.block) == BLOCK:
            self._join(tuple(frozenset((q,)) for q in range(4)))
            self._settle()
        self.block.append((initial, blank or again, truncated and not again))
        self.rows.append((role, text))

    def _join(self, ends: tuple[frozenset[int], ...]) -> None:
        paths = {}
        for k, goals in enumerate(ends):
            found = []
            for start, (cost, edits) in self.paths.items():
                on = search(self.block, start, goals)
                if on is not None:
                    found.append((cost + on[0], edits + on[1]))
            if found:
                paths[k] = min(found)
        self.paths, self.block = paths, []

    def _settle(self) -> None:
        best = min(c + _DEARER[q] for q, (c, _) in self.paths.items())
        self.paths = {q: p for q, p in self.paths.items() if p[0] <= best + _CHEAPER[q]}  # the others can't win any more
        edits = [e for _, e in self.paths.values()]
        low, high = min(edits), max(edits)
        common = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(map(len, edits)))
        self._apply(low[:common])
        self.paths = {q: (c, e[common:]) for q, (c, e) in self.paths.items()}

    def _apply(self, edits: str) -> None:
        for e in edits:
            if e == "D":
                self.rows.popleft()
                continue
            role, text = ("", "") if e == "I" else self.rows.popleft()
            if e == "K":
                self.state = SYSTEM if role[:1] == "s" else _FOLLOWS[self.state]
            else:
                self.state = _FOLLOWS[self.state]
                role = _ROLE[self.state]
            self.emit(e, role, text)
        self.audit += edits.encode()

    def finish(self) -> None:
        self._join((ACCEPTING,))
        self.cost, edits = self.paths[0]
        self._apply(edits)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)


def _ordered(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"))
    same = Window.partitionBy("conv", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first())
    return (rows.repartition("conv").withColumn("again", F.row_number().over(same) > 1)
            .sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text"))


def _walk(batches: Iterator[pa.RecordBatch], begin: Callable[[object], Conversation]) -> Iterator[tuple[object, Conversation, bool]]:
    """(id, conversation, whether it is complete): each conversation of a sorted stream at its end, the current one after each batch."""
    key, now = None, None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "present", "again")]
        for conv, turn, role, text, present, again in zip(*cols):
            if now is None or conv != key:
                if now is not None:
                    now.finish()
                    yield key, now, True
                key, now = conv, begin(conv)
            if present:
                now.add(turn, role, text, again)
        yield key, now, False
    if now is not None:
        now.finish()
        yield key, now, True


def _batches(rows: list[tuple], schema: pa.Schema, at_least: int) -> Iterator[pa.RecordBatch]:
    """The rows as a batch, and the list emptied, once there are enough."""
    if len(rows) >= at_least:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()


class _Digest:
    """SHA-256 of ``role:text`` lines."""

    def __init__(self):
        self.sha, self.between = hashlib.sha256(), b""

    def __call__(self, edit: str, role: str, text: str) -> None:
        self.sha.update(self.between + f"{role}:{text}".encode())
        self.between = b"\n"


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """One row for each conversation: its id, gaps, counts of faults, cost, audit and the SHA-256 of the repaired
    ``role:text`` lines.  ``present``: rows where it is not true only announce their conversation."""
    key = T.StructField(conv_col, df.schema[conv_col].dataType)
    out = T.StructType([key, *(T.StructField(c, T.LongType()) for c in _COUNTS), *(T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256"))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for conv, c, complete in _walk(batches, lambda _: Conversation(_Digest())):
            if complete:
                rows.append((conv, *(getattr(c, n) for n in _COUNTS), c.audit.decode(), c.emit.sha.hexdigest()))
                yield from _batches(rows, arrow, BATCH)
        yield from _batches(rows, arrow, 1)

    return _ordered(df, conv_col, turn_col, role_col, text_col, present).mapInArrow(W.giving_back(run), out)


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired conversations row by row: id, position from 0, edit (K, R or I), role and text."""
    key = T.StructField(conv_col, df.schema[conv_col].dataType)
    out = T.StructType([key, T.StructField("position", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def begin(conv: object) -> Conversation:
            position = itertools.count()
            return Conversation(lambda *edited: rows.append((conv, next(position), *edited)))

        for _ in _walk(batches, begin):  # rows that are final leave, however long the conversation
            yield from _batches(rows, arrow, BATCH)
        yield from _batches(rows, arrow, 1)

    return _ordered(df, conv_col, turn_col, role_col, text_col, present).mapInArrow(W.giving_back(run), out)
