"""Substring dedup: remove every later copy of a repeated word window.

A *suffix* is the word sequence that starts at a word of a document.  Two
windows are equal when their suffixes share a node at depth ``window`` of the
generalised suffix tree, so the deep internal nodes are the repeats.  The tree
is built in prefix partitions, never as one object:

1. **Variable-length prefixes.**  The prefix of a suffix ends with its anchor:
   the ``gram``-word sequence with the smallest fingerprint among those inside
   the suffix's first ``window`` words (leftmost on ties).  Equal windows have
   equal prefixes, between ``gram`` and ``window`` words long.  Consecutive
   suffixes share an anchor, so there are only about 2/(window-gram+2) anchors
   a word.  An anchor that occurs once in the corpus heads a subtree with a
   single leaf: it has no internal node and is cut off here.
2. **Subtrees.**  The remaining suffixes are dealt by the fingerprint of their
   path down to depth ``window`` and sorted; equal neighbours are the leaves
   under one deep node.  The first leaf (smallest document, then start) stays,
   the others are repeats.  A slice of rows first keeps one leaf a node and
   settles its own other leaves, so a passage in a third of all documents
   reaches a task once for each slice, not once for each document.
3. The repeats, as word ranges (start << 32 | end), go back to their documents.

Paths are 96-bit fingerprints of the words.  Both joins with the texts have the
same key and columns, so the texts are shuffled once.  Sorting spills to disk;
Python holds one Arrow batch at a time.

Defined cases: a null or blank text has no words; texts below ``window`` words
lose nothing; a null id counts as the smallest id; a row repeated in full (same
id and text) is one document and each copy gets the same result; rows that
share an id but not the text are ordered by a hash of the text; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.llm import words as W

#: Stands for a null id in the order of documents.
NULL_ID = -(1 << 63)


def _anchors(ids: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts that lie in one row, gram fingerprints, anchor position of each such start)."""
    ok = W.valid_windows(first, window)
    starts = np.flatnonzero(ok)
    if len(starts) == 0:
        return starts, np.zeros(0, np.uint64), starts
    grams = W.window_hashes(ids, gram)
    bits = np.uint64(max(1, int(len(grams) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, have = window - gram + 1, 1
    while have < span:  # minimum over `span` grams by doubling
        step = min(have, span - have)
        packed = np.minimum(packed[:-step], packed[step:])
        have += step
    return starts, grams, (packed[starts] & low).astype(np.int64)


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from W.slices(whole, "text")


def _hash_ids(batch: pa.RecordBatch) -> tuple[W.Words, np.ndarray]:
    w = W.words_of(batch.column("text"))
    return w, W.word_hashes(w)


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text_slices(batches):
            w, ids = _hash_ids(b)
            starts, grams, at = _anchors(ids, w.first, window, gram)
            if len(starts) == 0:
                continue
            new = np.ones(len(at), dtype=bool)
            new[1:] = at[1:] != at[:-1]  # anchors move to the right only
            at = at[new]
            row = np.searchsorted(w.first, at, side="right") - 1
            yield pa.record_batch({"h": pa.array(grams[at].view(np.int64)), "id0": b.column("id0").take(pa.array(row))})
    return run


def _suffix_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text_slices(batches):
            w, ids = _hash_ids(b)
            starts, grams, at = _anchors(ids, w.first, window, gram)
            if len(starts) == 0:
                continue
            row = np.searchsorted(w.first, starts, side="right") - 1
            lists = b.column("anchors")
            owner = np.repeat(np.arange(b.num_rows, dtype=np.uint64), np.diff(lists.offsets.to_numpy()))
            have = lists.flatten().to_numpy().view(np.uint64) ^ W.mix(owner + np.uint64(1))
            keep = np.isin(grams[at] ^ W.mix(row.astype(np.uint64) + np.uint64(1)), have)
            starts, row = starts[keep], row[keep]
            if len(starts) == 0:
                continue
            w1 = W.window_hashes(ids, window)[starts]
            w2 = W.window_hashes(W.mix(ids ^ np.uint64(0x5851F42D4C957F2D)), window)[starts].astype(np.uint32).view(np.int32)
            id0, tkey = b.column("id0").to_numpy()[row], b.column("tkey").to_numpy()[row]
            s = starts - w.first[row]
            order = np.lexsort((s, tkey, id0, w2, w1))
            w1, w2, id0, tkey, s = w1[order], w2[order], id0[order], tkey[order], s[order]
            head = np.ones(len(s), dtype=bool)
            head[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            at_head = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = ~((id0 == id0[at_head]) & (tkey == tkey[at_head]) & (s == s[at_head]))
            yield pa.record_batch({
                "w1": pa.array(w1[head].view(np.int64)), "w2": pa.array(w2[head]),
                "id0": pa.array(id0[head]), "tkey": pa.array(tkey[head]),
                "lo": pa.array(s[head].astype(np.int32)), "hi": pa.array(np.full(int(head.sum()), -1, np.int32)),
            })
            if later.any():
                lo, hi, i, t = _runs(id0[later], tkey[later], s[later], window)
                yield pa.record_batch({
                    "w1": pa.array(i), "w2": pa.array(t), "id0": pa.array(i), "tkey": pa.array(t),
                    "lo": pa.array(lo), "hi": pa.array(hi),
                })
    return run


def _runs(id0: np.ndarray, tkey: np.ndarray, s: np.ndarray, window: int):
    """Word ranges that the windows starting at ``s`` cover, joined where starts are consecutive."""
    order = np.lexsort((s, tkey, id0))
    id0, tkey, s = id0[order], tkey[order], s[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (id0[1:] != id0[:-1]) | (tkey[1:] != tkey[:-1]) | (s[1:] > s[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(s) - 1)
    return s[at].astype(np.int32), (s[last] + window).astype(np.int32), id0[at], tkey[at]


def _deep_nodes(window: int):
    """Input sorted by (w1, w2, id0, tkey, lo): leaves of one node are neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # (w1, w2, id0, tkey, lo) of the first leaf of the last node seen
        for b in batches:
            known = b.column("hi").to_numpy() >= 0
            w1, w2, id0, tkey, lo, hi = (b.column(c).to_numpy() for c in ("w1", "w2", "id0", "tkey", "lo", "hi"))
            parts = [(id0[known], tkey[known], lo[known], hi[known])]
            w1, w2, id0, tkey, lo = (x[~known] for x in (w1, w2, id0, tkey, lo))
            if len(w1):
                if head is not None:
                    w1, w2, id0, tkey, lo = (np.concatenate(([h], x)) for h, x in zip(head, (w1, w2, id0, tkey, lo)))
                new = np.ones(len(w1), dtype=bool)
                new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
                at = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = ~((id0 == id0[at]) & (tkey == tkey[at]) & (lo == lo[at]))
                first = int(at[-1])
                head = tuple(x[first] for x in (w1, w2, id0, tkey, lo))
                if later.any():
                    a, z, i, t = _runs(id0[later], tkey[later], lo[later].astype(np.int64), window)
                    parts.append((i, t, a, z))
            i, t, a, z = (np.concatenate(x) for x in zip(*parts))
            yield pa.record_batch({"id0": pa.array(i.astype(np.int64)), "tkey": pa.array(t.astype(np.int32)),
                                   "span": pa.array(a.astype(np.int64) << 32 | z)})
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _text_slices(batches):
        w = W.words_of(b.column("text"))
        n = len(w.starts)
        lists = b.column("ranges")
        owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        found = lists.flatten()
        depth = np.zeros(n + 1, dtype=np.int64)
        if len(found):
            mine = found.field("tkey").to_numpy() == b.column("tkey").to_numpy()[owner]
            owner, span = owner[mine], found.field("span").to_numpy()[mine]
            np.add.at(depth, w.first[owner] + (span >> 32), 1)
            np.add.at(depth, w.first[owner] + (span & 0xFFFFFFFF), -1)
        keep = np.cumsum(depth)[:n] == 0
        counts = np.diff(w.first)
        kept = np.add.reduceat(np.append(keep, False).astype(np.int64), w.first[:-1]) if b.num_rows else counts
        kept = np.where(counts > 0, kept, 0)
        yield pa.record_batch({
            "id": b.column("id"),
            "kept_text": pa.array([W.joined(w, keep, r).decode() for r in range(b.num_rows)], pa.string()),
            "n_words": pa.array(counts), "n_removed": pa.array(counts - kept),
        })


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 20, gram: int = 6) -> DataFrame:
    """One row per input row: id, kept_text, n_words, n_removed.

    ``window``: words of a repeat; ``gram``: words of an anchor (at most ``window``).
    """
    gram = min(gram, window)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = base.select("id", F.coalesce("id", F.lit(NULL_ID)).alias("id0"), F.hash("text").alias("tkey"),
                       F.coalesce("text", F.lit("")).alias("text"))
    anchors = base.select("id0", "text").mapInArrow(_anchor_rows(window, gram), "h long, id0 long")
    # Only rows that share an id need a text key: elsewhere it is 0 and costs nothing.
    shared = (base.groupBy("id0").agg(F.min("tkey").alias("a"), F.max("tkey").alias("z")).filter("a <> z")
              .select("id0", F.lit(True).alias("shared")))
    base = base.join(shared, "id0", "left").select("id", "id0", F.when(F.col("shared"), F.col("tkey")).otherwise(0).alias("tkey"), "text")
    repeated = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    held = anchors.join(repeated, "h", "left_semi").groupBy("id0").agg(F.collect_set("h").alias("anchors"))
    leaves = (base.join(held, "id0").select("id", "id0", "tkey", "text", "anchors")
              .mapInArrow(_suffix_rows(window, gram), "w1 long, w2 int, id0 long, tkey int, lo int, hi int"))
    spots = (leaves.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "id0", "tkey", "lo")
             .mapInArrow(_deep_nodes(window), "id0 long, tkey int, span long"))
    ranges = spots.groupBy("id0").agg(F.collect_set(F.struct("tkey", "span")).alias("ranges"))
    full = base.join(ranges, "id0", "left").select(
        "id", "id0", "tkey", "text",
        F.coalesce("ranges", F.array().cast("array<struct<tkey:int,span:bigint>>")).alias("ranges"))
    return (full.mapInArrow(_cut, "id long, kept_text string, n_words long, n_removed long")
            .withColumnRenamed("id", id_col))
