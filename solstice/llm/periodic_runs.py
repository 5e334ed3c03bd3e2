"""Periodic runs of words: every maximal stretch that repeats itself, and the text without the repeats.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``MIN_LENGTH`` and ``MIN_EXPONENT * q`` that no neighbouring word
extends keeping the period.

Method (Kruskal over falling LCPs): the suffixes of a text are sorted, and the
neighbours in that order are edges weighted by their longest common prefix
(LCP).  Edges are taken by falling LCP and unite two classes of suffixes, each
an ordered set of positions.  Two positions i < j that become neighbours in a
united set agree on exactly ``lcp`` words; if j - i is small enough against
``lcp``, the words from i on repeat with period j - i up to j + lcp.  Nothing
lies between the two in the class, so j - i is the smallest period; where the
word before i differs from the one before j, the run begins at i.  Each run is
met once, at its first position.  The smaller set goes into the larger, so a
position moves a logarithmic number of times.

Runs need an LCP of ``MIN_LCP`` words, so only texts that repeat some
``MIN_LCP`` words are sorted at all, and only such edges are united.  Suffixes
are sorted by prefix doubling in numpy, all texts of a bounded slice at once; a
single text that is longer is its own slice, in memory proportional to it.
Words are compared by 64-bit fingerprints; the words of every found run are then
compared themselves, and a text in which they differ is done again with exact
numbers for its words.  Texts are independent: there is no shuffle.

Defined cases: null and empty texts: no words, no runs, empty collapsed text;
repeated rows and null ids are rows like any other; a longest-exponent tie goes
to the smallest start, then period; other columns of the input are kept (a
column named like a result is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from solstice.llm import words as W

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: A run of period q has two suffixes with an LCP of its length less q: 5 or more.
MIN_LCP = 5

Run = tuple[int, int, int]  # start, length, period
_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_RUN_ARROW = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])


def _repeating_rows(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows in which some ``MIN_LCP`` words stand twice."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(W.valid_windows(first, MIN_LCP))
    if len(at) == 0:
        return at
    grams = W.window_hashes(ids, MIN_LCP)[at] ^ W.mix(rows[at].astype(np.uint64))
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    return np.unique(rows[at[order[1:][same]]])


def _suffixes(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks by prefixes of 1, 2, 4, … words (equal ranks: equal prefixes).

    ``keys``: a number for each word, different in different texts; ``ends``: the end of each word's text.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    place = np.arange(n)
    new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    levels, size = [rank.astype(np.int32)], 1
    active = order[~(new & np.concatenate((new[1:], [True])))]
    while len(active):
        after = active + size
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group, place = rank[active], np.arange(len(active))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.concatenate(([True], group[1:] != group[:-1]))
        rank[active] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        levels.append(rank.astype(np.int32))
        active = active[~(new & np.concatenate((new[1:], [True])))]
        size *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def _edges(keys: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Neighbours in the order of suffixes with their LCP, the greatest LCP first."""
    suffixes, levels = _suffixes(keys, ends)
    a, b = suffixes[:-1], suffixes[1:]
    if len(levels) <= 2:  # no four words are repeated
        return [], [], []
    near = levels[2][a] == levels[2][b]
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), dtype=np.int64)
    last = len(keys) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        same = (x < ends[a]) & (y < ends[b])
        same &= levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)]
        lcp[same] += 1 << k
    keep = np.flatnonzero(lcp >= MIN_LCP)
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    return a[keep].tolist(), b[keep].tolist(), lcp[keep].tolist()


def _seeds(small: list[int], large: list[int]) -> list[tuple[int, int]]:
    """Positions of the two ordered sets that are neighbours in their union, one of each set."""
    if len(small) == 1:
        k = bisect_left(large, small[0])
        return [(large[k - 1], small[0])] * (k > 0) + [(small[0], x) for x in large[k : k + 1]]
    at = [bisect_left(large, s) for s in small]
    out = []
    for n, (s, k) in enumerate(zip(small, at)):
        if k and (n == 0 or at[n - 1] < k):
            out.append((large[k - 1], s))
        if k < len(large) and (n + 1 == len(small) or at[n + 1] > k):
            out.append((s, large[k]))
    return out


def find_runs(keys: np.ndarray, first: np.ndarray) -> list[list[Run]]:
    """Runs of each text, by start and period; text r has the words ``first[r]:first[r + 1]`` of ``keys``."""
    n_rows = len(first) - 1
    out: list[list[Run]] = [[] for _ in range(n_rows)]
    rows = np.repeat(np.arange(n_rows), np.diff(first))
    if len(keys) < MIN_LENGTH:
        return out
    a, b, lcp = _edges(keys, first[1:][rows])
    word, home = keys, {}
    for x, y, depth in zip(a, b, lcp):
        large, small = home.get(x) or [x], home.get(y) or [y]
        if len(small) > len(large):
            large, small = small, large
        reach = depth // (MIN_EXPONENT - 1)
        for i, j in _seeds(small, large):
            if j - i <= reach and (i == first[rows[i]] or word[i - 1] != word[j - 1]):
                r = int(rows[i])
                out[r].append((i - int(first[r]), depth + j - i, j - i))
        if len(large) == 1:
            home[large[0]] = large
        for s in small:
            home[s] = large
        if len(small) <= 8:
            for s in small:
                insort(large, s)
        else:
            large.extend(small)
            large.sort()
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def _row_runs(w: W.Words, ids: np.ndarray) -> dict[int, list[Run]]:
    """Row -> its runs, only rows that have some."""
    out = {}
    chosen = _repeating_rows(ids, w.first)
    if len(chosen) == 0:
        return out
    counts = np.diff(w.first)[chosen]
    first = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(w.first[chosen] - first[:-1], counts) + np.arange(first[-1])
    keys = ids[at] ^ W.mix(np.repeat(chosen, counts).astype(np.uint64))
    for row, runs in zip(chosen.tolist(), find_runs(keys, first)):
        if runs:
            a, b = int(w.first[row]), int(w.first[row + 1])
            words = [w.data[s:e].tobytes() for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist())]
            if any(words[s : s + n - q] != words[s + q : s + n] for s, n, q in runs):  # fingerprints lied
                number: dict[bytes, int] = {}
                exact = np.array([number.setdefault(x, len(number)) for x in words], dtype=np.uint64)
                runs = find_runs(exact, np.array([0, b - a]))[0]
        if runs:
            out[row] = runs
    return out


def with_runs(df: DataFrame, text_col: str = "text", runs_col: str = "runs", best_col: str = "best_run", collapsed_col: str = "collapsed") -> DataFrame:
    """Every row with its runs (array of start, length, period), the one of the greatest length / period (null: none)
    and the words that no run repeats, joined by one space (a run keeps its first period)."""
    new = [(runs_col, T.ArrayType(_RUN, False)), (best_col, _RUN), (collapsed_col, T.StringType())]
    names = [n for n, _ in new]
    out = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, text_col):
                w = W.words_of(b.column(text_col))
                found = _row_runs(w, W.word_hashes(w))
                keep = np.ones(len(w.starts), dtype=bool)
                runs, best = [], []
                for r in range(b.num_rows):
                    mine, a = found.get(r, []), int(w.first[r])
                    for s, n, q in mine:
                        keep[a + s + q : a + s + n] = False
                    runs.append([dict(zip(_RUN.names, x)) for x in mine])
                    best.append(dict(zip(_RUN.names, min(mine, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])))) if mine else None)
                texts = [W.joined(w, keep, r).decode("utf-8", "replace") for r in range(b.num_rows)]
                kept = [c for c in b.schema.names if c not in names]
                cols = [b.column(c) for c in kept]
                cols += [pa.array(runs, pa.list_(pa.field("element", _RUN_ARROW, False))), pa.array(best, _RUN_ARROW), pa.array(texts, pa.string())]
                yield pa.record_batch(cols, names=[*kept, *names])

    return df.mapInArrow(W.giving_back(run), out)
