"""N-gram Jaccard join: classes of documents linked by similar shingle sets.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets
of distinct ``n``-word shingles.  Equal sets form one *class* first (by a
fingerprint of the set); only one set of each class is joined.

* **Rare-first prefix filter.**  Shingles are ordered by (outside the counted
  share, document frequency, hash) and linked sets must share one of their
  first ``size - needed + 1`` shingles.  Any fixed order is right, so only a
  hashed share of the shingles, ``SPARE`` times a prefix's share of a set, is
  counted and put first; a set whose
  counted shingles don't fill its prefix has all its shingles counted.  Counts
  cover all documents.  A shingle of a single class can't join: it takes its
  place in the prefix and is dropped.
* **Length, positional and suffix filters** hold in the join condition.  The
  suffix filter splits the shingle space into ``64 * LONGS`` parts: the number
  of parts in which two sets hold counts of different parity is a lower bound
  of the sets' symmetric difference.
* **No pair twice, no square of a group.**  In each prefix list every set first
  meets a few hubs: the sets with the smallest share of shingles that no other
  set holds, so the likely originals of a group.  Verified links give components.  Then only pairs from different components remain, with one side
  outside the list's largest component, so no link between components is lost
  and a large group of near copies costs a multiple of its size.
* **Verification** intersects whole sets, once a pair; one set of the pair is
  kept once for a salted share of its partners.

Lists, minima and components are partial aggregates and joins that Spark may
split; nothing is gathered on the driver.

Defined cases: null, empty or blank text: empty set, no links, own id as
component (null for a null id).  A null id counts as the smallest id; its
component's id is null.  Repeated rows fall into one class.  Rows that share an
id but not the text are separate sets.  Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.llm import words as W
from solstice.llm.graph import components, stored

NULL_ID = -(1 << 63)
#: The counted shingles are this many times what a prefix takes of a set.
SPARE = 1.3
#: 64-bit words of the suffix filter.
LONGS = 8
_PARTS = [f"p{k}" for k in range(LONGS)]
#: Hubs of a prefix list.
HUBS = 3
#: Shares into which the partners of one set are dealt for verification.
SALTS = 16
#: Bytes of text handled at once.
PART = 1 << 20

_U = np.uint64


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct ``n``-word shingles of each lower-cased text, sorted by both."""
    w = W.words_of(texts, lower=True)
    ids = W.word_hashes(w)
    counts = np.diff(w.first)
    at = np.flatnonzero(W.valid_windows(w.first, n))
    rows, grams = np.searchsorted(w.first, at, side="right") - 1, W.window_hashes(ids, n)[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        alone = [W.window_hashes(ids[w.first[r]:w.first[r + 1]], int(counts[r]), seed=int(counts[r]))[0] for r in short]
        rows, grams = np.concatenate((rows, short)), np.concatenate((grams, np.array(alone, dtype=np.uint64)))
        order = np.argsort(rows, kind="stable")
        rows, grams = rows[order], grams[order]
    edge = np.searchsorted(rows, np.arange(len(counts) + 1)).tolist()
    for a, z in zip(edge, edge[1:]):
        grams[a:z].sort()
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def _kept_of_64(percent: int) -> int:
    """A shingle is counted when its last six bits are below this."""
    return min(64, math.ceil(64 * SPARE * (100 - percent) / 100) or 1)


def _signatures(rows: np.ndarray, grams: np.ndarray, n_rows: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, class fingerprint, counted shingles) of each row's set."""
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    size = np.diff(first)
    total = np.concatenate(([_U(0)], np.cumsum(W.mix(grams ^ _U(0xA0761D6478BD642F)))))
    total2 = np.concatenate(([_U(0)], np.cumsum(W.mix(grams ^ _U(0xE7037ED1A0B428DB)))))
    a, b = total[first[1:]] - total[first[:-1]], total2[first[1:]] - total2[first[:-1]]
    key = W.mix(W.mix(a) * _U(3) + W.mix(b) + size.astype(np.uint64))
    counted = np.concatenate(([0], np.cumsum(grams % _U(64) < _U(_kept_of_64(percent)))))
    return size, key, counted[first[1:]] - counted[first[:-1]]


def _needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a linked set of any size: ceil(percent/100 * size)."""
    return -(-size * percent // 100)


def _class_rows(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, "text", PART):
                size, key, counted = _signatures(*shingle_sets(b.column("text"), n), b.num_rows, percent)
                yield pa.record_batch({"id0": b.column("id0"), "tkey": b.column("tkey"), "f": pa.array(key.view(np.int64)),
                                       "size": pa.array(size), "counted": pa.array(counted)})
    return W.giving_back(run)


def _counted_rows(n: int, percent: int):
    """(shingle, class) of the counted shingles; a slice gives each class once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, "text", PART):
                rows, grams = shingle_sets(b.column("text"), n)
                size, key, counted = _signatures(rows, grams, b.num_rows, percent)
                once = np.zeros(b.num_rows, dtype=bool)
                once[np.unique(key, return_index=True)[1]] = True
                whole_set = counted < size - _needed(size, percent) + 1
                take = once[rows] & (whole_set[rows] | (grams % _U(64) < _U(_kept_of_64(percent))))
                yield pa.record_batch({"h": pa.array(grams[take].view(np.int64)), "f": pa.array(key[rows[take]].view(np.int64))})
    return W.giving_back(run)


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, "text", PART):
                rows, grams = shingle_sets(b.column("text"), n)
                first = np.searchsorted(rows, np.arange(b.num_rows + 1))
                part = rows * (64 * LONGS) + (grams >> _U(40)).astype(np.int64) % (64 * LONGS)
                odd = (np.bincount(part, minlength=b.num_rows * 64 * LONGS) & 1).astype(np.uint8)
                bits = np.packbits(odd, bitorder="little").view(np.int64).reshape(b.num_rows, LONGS)
                yield pa.record_batch({
                    "f": b.column("f"), "size": b.column("size"),
                    **{c: pa.array(bits[:, k].copy()) for k, c in enumerate(_PARTS)},
                    "grams": pa.array([grams[s:e].tobytes() for s, e in zip(first[:-1], first[1:])], pa.binary()),
                })
    return W.giving_back(run)


def _verify(percent: int):
    """Input sorted by (u, salt, v): the set of u (v null) comes before its partners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, None
        for b in batches:
            us, vs, out = b.column("u").to_pylist(), b.column("v"), []
            for i, (u, v) in enumerate(zip(us, vs.to_pylist())):
                g = np.frombuffer(b.column("grams")[i].as_buffer(), dtype=np.uint64)
                if v is None:
                    held, mine = u, g
                    continue
                assert held == u, "a pair without its first set"
                both = int((mine[np.minimum(np.searchsorted(mine, g), len(mine) - 1)] == g).sum())
                if 100 * both >= percent * (len(mine) + len(g) - both):
                    out.append((u, v))
            if out:
                yield pa.record_batch({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})
            if held is not None:
                mine = mine.copy()  # let the batch go
    return W.giving_back(run)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link, each verified on the whole sets."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    grams = sets.select(F.col("f"), "grams")
    left = pairs.select("u", "salt").distinct().join(grams, F.col("u") == F.col("f")).select(
        "u", "salt", F.lit(None).cast("long").alias("v"), "grams")
    right = pairs.join(grams, F.col("v") == F.col("f")).select("u", "salt", "v", "grams")
    return (left.union(right).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
            .mapInArrow(_verify(percent), "u long, v long"))


def _may_link(percent: int):
    """Length, positional and suffix filters between rows x and y of one prefix list."""
    lo, hi = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    # overlap needed: (percent / (100 + percent)) * (sum of sizes), rounded up
    need = F.ceil((F.col("x.size") + F.col("y.size")) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-6))
    rest = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _PARTS), F.lit(0))
    return (lo * 100 >= hi * percent) & (rest >= need) & (apart <= F.col("x.size") + F.col("y.size") - need * 2)


def _prefix_lists(base: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(h, f, size, pos, alone): prefix shingles that at least two classes hold in their prefix.

    ``alone``: per mille of the class's counted shingles that no other class holds.
    """
    counted = base.select("text").mapInArrow(_counted_rows(n, percent), "h long, f long")
    freq = (counted.groupBy("h").agg(F.min("f").alias("f0"), F.max("f").alias("f1"), F.count(F.lit(1)).alias("df"))
            .filter("f0 <> f1").select("h", "df"))
    inside = F.col("h").bitwiseAND(63) < _kept_of_64(percent)
    shared = counted.join(freq, "h").groupBy("f").agg(
        F.sort_array(F.collect_set(F.struct((~inside).alias("out"), "df", "h"))).alias("hs"))
    sized = shared.join(classes.select("f", "size", "counted"), "f")
    # Counted once a class, before the explode: an expression over the array beside it would run for every element.
    first_out = F.array_position(F.col("hs.out"), True)
    sized = sized.withColumn("n_hs", F.size("hs")).withColumn("n_in", F.when(first_out == 0, F.col("n_hs")).otherwise(first_out - 1))
    ranked = sized.select("f", "size", "counted", "n_hs", "n_in", F.posexplode("hs").alias("i", "x"))
    all_counted = F.when(F.expr(f"counted < size - (size * {percent} + 99) div 100 + 1"), F.col("size")).otherwise(F.col("counted"))
    alone = (1000 - F.floor(F.col("n_hs") * 1000 / all_counted)).cast("int")
    # Shingles of one class come first within their share: they only shift the others.
    pos = F.when(~F.col("x.out"), F.col("counted") - F.col("n_in") + F.col("i")).otherwise(
        F.col("size") - F.col("n_hs") + F.col("i"))
    need = F.expr(f"(size * {percent} + 99) div 100")
    prefix = ranked.select("f", "size", F.col("x.h").alias("h"), pos.alias("pos"), alone.alias("alone")).filter(F.col("pos") < F.col("size") - need + 1)
    prefix = stored(prefix, "prefix")  # read twice
    live = prefix.groupBy("h").agg(F.min("f").alias("f0"), F.max("f").alias("f1")).filter("f0 <> f1").select("h")
    return prefix.join(live, "h", "left_semi")


def _hubs(lists: DataFrame) -> DataFrame:
    """(h, f, size, pos): up to ``HUBS`` sets of each list, those of the least ``alone``, each once.

    The suffix filter's words are no part of the minima: Spark sorts the rows for these.
    """
    picks = [F.min(F.struct("alone", F.xxhash64("f", F.lit(k)).alias("o"), "f", "size", "pos")).alias(f"k{k}") for k in range(HUBS)]
    some = F.array_distinct(F.array(*[F.struct(f"k{k}.f", f"k{k}.size", f"k{k}.pos") for k in range(HUBS)]))
    return lists.groupBy("h").agg(*picks).select("h", F.explode(some).alias("y")).select("h", "y.*")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       n: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), text_key, is_first.

    ``is_first``: no row of the component has a smaller (id, ``text_key``); ``text_key`` is a hash of the text.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id0"), F.col(text_col).alias("text"))
    base = base.select(F.coalesce("id0", F.lit(NULL_ID)).alias("id0"), F.hash("text").alias("tkey"), "text")
    rows = stored(base.mapInArrow(_class_rows(n, percent), "id0 long, tkey int, f long, size long, counted long"), "classes")
    classes = (rows.filter("size > 0").groupBy("f").agg(
        F.min(F.struct("id0", "tkey")).alias("rep"), F.first("size").alias("size"), F.first("counted").alias("counted"))
        .select("f", "rep.id0", "rep.tkey", "size", "counted"))
    lists = stored(_prefix_lists(base, classes, n, percent), "lists")
    wanted = classes.join(lists.select("f").distinct(), "f", "left_semi").select("f", "size", "id0", "tkey")
    packed = wanted.join(base, ["id0", "tkey"]).dropDuplicates(["f"]).select("f", "size", "text")
    sets = stored(packed.mapInArrow(_set_rows(n), f"f long, size long, {', '.join(c + ' long' for c in _PARTS)}, grams binary"), "sets")
    parts = sets.select("f", *_PARTS)
    rich = lists.drop("alone").join(parts, "f").select("h", "f", "size", "pos", *_PARTS)

    # Every set against the hubs of its lists.
    hubs = _hubs(lists).join(parts, "f").select("h", "f", "size", "pos", *_PARTS)
    near = (rich.alias("x").join(hubs.alias("y"), F.col("x.h") == F.col("y.h"))
            .filter((F.col("x.f") != F.col("y.f")) & _may_link(percent))
            .select(F.least("x.f", "y.f").alias("u"), F.greatest("x.f", "y.f").alias("v")).distinct())
    first = stored(_links(near, sets, percent), "links")
    seen = components(first)

    # Pairs of different components; one side lies outside the list's largest component.
    own = rich.join(seen.withColumnRenamed("node", "f"), "f", "left").withColumn("c", F.coalesce("label", "f")).drop("label")
    shares = own.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"))
    largest = shares.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("big"), F.count(F.lit(1)).alias("n_parts")).filter("n_parts > 1")
    both = stored(own.join(largest.select("h", "big"), "h"), "mixed")
    rest = (both.filter("c <> big").alias("x").join(both.alias("y"), (F.col("x.h") == F.col("y.h"))
            & (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.big")) | (F.col("x.f") < F.col("y.f"))) & _may_link(percent))
            .select(F.least("x.f", "y.f").alias("u"), F.greatest("x.f", "y.f").alias("v")).distinct())
    edges = first.union(_links(rest, sets, percent))
    found = components(edges)

    # Names of the components, then back to the rows.
    ids = classes.select("f", "id0", "tkey").join(found.withColumnRenamed("node", "f"), "f")
    names = ids.groupBy("label").agg(F.min(F.struct("id0", "tkey")).alias("rep"))
    named = found.join(names, "label").select(F.col("node").alias("f"), "rep")
    per_class = classes.select("f", F.struct("id0", "tkey").alias("own")).join(named, "f", "left").select("f", F.coalesce("rep", "own").alias("rep"))
    out = rows.filter("size > 0").join(per_class, "f").select("id0", "tkey", "size", "rep").union(
        rows.filter("size = 0").select("id0", "tkey", "size", F.struct("id0", "tkey").alias("rep")))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("id0").alias(id_col), F.col("size").alias("n_shingles"), null("rep.id0").alias("component_id"),
                      F.col("tkey").alias("text_key"), (F.struct("id0", "tkey") == F.col("rep")).alias("is_first"))
