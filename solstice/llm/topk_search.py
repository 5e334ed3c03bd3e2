"""Exact top-k search by inner product with pivot-table elimination.

Vectors are turned into integers, ``floor(scale * x)``, and scored by the exact
integer inner product.  A further coordinate ``sqrt(M^2 - |v|^2)`` (0 for a
query) gives all candidates the same length, so the largest inner products are
the smallest Euclidean distances: ``d^2 = |q|^2 + M^2 - 2 q.v``.

*Precomputed* for each candidate is its distance to every pivot (the pivot
table).  Candidates of a task are ordered by their nearest pivot and the
distance to it and cut into groups; a group keeps the least and the largest
distance to each pivot.  By the triangle inequality the largest gap between
``d(q, p)`` and that interval over all pivots is a lower bound of ``d(q, v)`` for
all of the group.  A block of queries meets the groups in the order of their
bounds; a query takes part in a group unless the bound exceeds its k-th best
distance so far, and meets a group's candidates in one product of matrices (a
bound for each candidate costs more than its score there).  Bounds carry a
margin for rounding; scores are exact integers, so the result is exact.

Candidates are dealt into shares, each once.  A share is a task's work and holds
up to ``HELD`` components; every query meets every share, streamed past the
share's candidates in blocks, and brings k rows from each, merged by a window
per query.  So queries are stored once a share and nothing is stored for a pair.
The driver sees counts by length and a bounded sample of distinct vectors
(``PIVOT_SAMPLE`` rows, ``SAMPLE_VALUES`` components), cut by hash on the
executors; its spread-out rows are the pivots, which only decide how much is skipped.

Defined cases: null vectors, and vectors that hold a null or non-finite
component, take no part.  Vectors are compared only with vectors of the same
length.  A null id takes no part as a query and is a candidate with a null id
that loses ties.  Rows that share an id are separate candidates; a query never
meets a candidate of its own id; repeated query rows are searched once for each
distinct vector.  Scores beyond 64 bits are held at the limits.  Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows sampled for choosing pivots, components they may have together, and pivots chosen.
PIVOT_SAMPLE, SAMPLE_VALUES, PIVOTS = 2000, 1 << 20, 32
#: Components (or distances to pivots) of the candidates that a task holds, rows that make a share worth a task, candidates of a group.
HELD, LEAST, GROUP = 1 << 23, 2048, 512
NO_ID = (1 << 63) - 1  # stands for a null id: it loses ties
LOWEST = -(1 << 63)


def _blocks(size: int, scale: int, shares: int = 1):
    """Rows of up to ``size`` integer vectors of one length, dealt out to ``shares`` in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        context = TaskContext.get()
        made = 31 * context.partitionId() if context else 0

        def row(ids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            top = np.abs(vecs).max(initial=0)
            kind = next((t for t in ("<i2", "<i4") if top <= np.iinfo(t).max), "<f8")
            return pa.record_batch({"share": pa.array([made % shares], pa.int32()), "dim": pa.array([vecs.shape[1]], pa.int32()), "kind": pa.array([kind]),
                                    "ids": pa.array([ids.tobytes()], pa.binary()), "vecs": pa.array([vecs.astype(kind).tobytes()], pa.binary())})

        def rows(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for a in range(0, len(ids), size):
                if len(ids) - a >= least:
                    yield row(ids[a : a + size], vecs[a : a + size])
                else:
                    held[dim] = [(ids[a:], vecs[a:])]

        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("v")
            x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ids = b.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lengths = np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                held.setdefault(dim, []).append((ids[at], x[starts[at][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[dim]) >= size:
                    yield from rows(dim, size)
        for dim in list(held):
            yield from rows(dim, 1)
    return run


def _matrix(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b.column("ids")[i].as_buffer(), dtype=np.int64)
    vecs = np.frombuffer(b.column("vecs")[i].as_buffer(), dtype=b.column("kind")[i].as_py())
    return ids, vecs.reshape(len(ids), b.column("dim")[i].as_py())


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each next row is the one farthest from those chosen so far."""
    if not len(sample):
        return sample
    chosen, apart = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x, dtype=np.float64)


def _distances(x: np.ndarray, pivots: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Distances of rows (the square of their further coordinate is ``rest``) to pivots (theirs is 0)."""
    x = x.astype(np.float64)
    return np.sqrt(np.maximum((_norms(x) + rest)[:, None] + _norms(pivots)[None] - 2 * x @ pivots.T, 0))


def _exact(q_norm: np.ndarray | float, c_norm: np.ndarray | float, bits: int) -> np.ndarray | bool:
    """Floats of so many bits are exact: no sum of parts of an inner product exceeds the product of the lengths."""
    return np.sqrt(np.maximum(q_norm, 1)) * np.sqrt(np.maximum(c_norm, 1)) * (1 + 1e-9) < 2.0 ** bits


def _scores(q: np.ndarray, c: np.ndarray, q_norms: np.ndarray, c_norms: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``q`` and ``c``: as floats where these are exact, else by Python integers."""
    kind = next((t for t, bits in ((np.float32, 24), (np.float64, 53)) if _exact(q_norms.max(), c_norms.max(), bits)), None)
    if kind:
        return q.astype(kind, copy=False) @ c.astype(kind, copy=False).T
    sure = _exact(q_norms[:, None], c_norms[None], 53)
    q, c = q.astype(np.float64), c.astype(np.float64)
    with np.errstate(all="ignore"):
        out = np.where(sure, q @ c.T, 0).astype(np.int64)
    for i, j in zip(*np.nonzero(~sure)):
        out[i, j] = min(max(sum(int(a) * int(b) for a, b in zip(q[i].tolist(), c[j].tolist())), LOWEST), NO_ID)
    return out


class Share(NamedTuple):
    """The candidates of a task by groups; norms: squared; least, most: by group and pivot, the distances; top: the largest of norms."""
    ids: np.ndarray
    vecs: np.ndarray
    norms: np.ndarray
    least: np.ndarray
    most: np.ndarray
    pivots: np.ndarray
    top: float
    group: int


def _share(blocks: list[tuple[np.ndarray, np.ndarray]], pivots: np.ndarray, group: int) -> Share:
    norms = [_norms(v.astype(np.float64)) for _, v in blocks]
    top = max(float(n.max()) for n in norms)
    table = np.concatenate([_distances(v, pivots, top - n) for (_, v), n in zip(blocks, norms)])
    ids = np.concatenate([i for i, _ in blocks])
    vecs = np.concatenate([v.astype(np.float32 if top < 2 ** 48 else np.float64) for _, v in blocks])
    near = table.argmin(1) if len(pivots) else np.zeros(len(ids), dtype=np.int64)
    order = np.lexsort((table[np.arange(len(ids)), near], near)) if len(pivots) else np.arange(len(ids))
    starts = np.arange(0, len(ids), group)
    table = table[order]
    return Share(ids[order], vecs[order], np.concatenate(norms)[order], np.minimum.reduceat(table, starts), np.maximum.reduceat(table, starts), pivots, top, group)


class Best:
    """The k best candidates so far of each query: flat, by query, score and id."""

    def __init__(self, k: int, q_ids: np.ndarray):
        self.k, self.q_ids, self.waits, self.waiting = k, q_ids, [], 0
        self.of = self.ids = self.scores = np.zeros(0, dtype=np.int64)
        n = len(q_ids)
        self.full, self.last, self.last_id = np.zeros(n, dtype=bool), np.full(n, LOWEST, dtype=np.int64), np.full(n, NO_ID, dtype=np.int64)

    def least(self, rows: np.ndarray, kind: np.dtype) -> np.ndarray:
        """What a score must reach."""
        if kind.kind == "f":
            return np.where(self.full[rows], self.last[rows].astype(kind), kind.type(-np.inf))
        return self.last[rows]

    def add(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """s: scores of the queries ``rows`` and the candidates ``ids``."""
        floor = self.least(rows, s.dtype)
        some = np.flatnonzero(s.max(1) >= floor)
        if not len(some):
            return
        rows, s, floor = rows[some], s[some], floor[some, None]
        hit = s >= floor
        n = np.count_nonzero(hit)
        if n > 8 * self.k * len(rows) or n > 2 * self.k * len(rows) and not self.full.any():
            own = self.q_ids[rows][:, None] == ids[None]
            s = np.where(own, s.dtype.type(-np.inf if s.dtype.kind == "f" else LOWEST), s)
            hit = ((s > floor) | ~self.full[rows][:, None] | (s == floor) & (ids[None] < self.last_id[rows][:, None])) & ~own
            if len(ids) > self.k:
                hit &= s >= np.partition(s, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]]
        at = np.flatnonzero(hit)  # many times as fast as nonzero
        of, ids, s = rows[at // len(ids)], ids[at % len(ids)], s.ravel()[at].astype(np.int64)
        other = ids != self.q_ids[of]
        self.waits.append((of[other], ids[other], s[other]))
        self.waiting += len(of)
        if self.waiting >= 2 * len(self.q_ids):
            self.merge()

    def merge(self) -> None:
        of, ids, s = (np.concatenate(x) for x in zip((self.of, self.ids, self.scores), *self.waits))
        order = np.lexsort((ids, ~s, of))  # ~s falls as s grows, at 64 bits, too
        of = of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        order, of, rank = order[rank < self.k], of[rank < self.k], rank[rank < self.k]
        self.of, self.ids, self.scores, self.waits, self.waiting = of, ids[order], s[order], [], 0
        last = rank == self.k - 1
        self.full[of[last]], self.last[of[last]], self.last_id[of[last]] = True, self.scores[last], self.ids[last]


def _nearest(k: int, q_ids: np.ndarray, q: np.ndarray, share: Share) -> tuple[Best, int]:
    """The best k of a share for each query, and how many pairs were scored."""
    best, scored, norms = Best(k, q_ids), 0, _norms(q.astype(np.float64))
    base = (norms + share.top)[:, None]
    most = np.broadcast_to(base, (len(q), len(share.least))) / 2
    if len(share.pivots):
        to = _distances(q, share.pivots, np.zeros(len(q)))
        gap = np.stack([np.maximum(np.maximum(a - to, to - z), 0).max(1) for a, z in zip(share.least, share.most)], axis=1)
        most = (base - gap ** 2) / 2
    # d >= gap means score <= most; the margin covers rounding of the distances. Clamped scores don't fall below the limit.
    most = np.maximum(most + 1e-6 * (base + 1), float(LOWEST))
    q = q.astype(share.vecs.dtype if _exact(norms.max(), share.top, 24) else np.float64)
    for g in np.argsort(-most.max(0), kind="stable").tolist():
        rows = np.flatnonzero(~(best.full & (most[:, g] < best.last)))  # a bound that is no number spares nothing
        if len(rows):
            part = slice(g * share.group, (g + 1) * share.group)
            ids = share.ids[part]
            best.add(rows, ids, _scores(q if len(rows) == len(q) else q[rows], share.vecs[part], norms[rows], share.norms[part]))
            scored += len(rows) * len(ids)
    if best.waits:
        best.merge()
    return best, scored


def _search(k: int, size: int, group: int, pivots: dict[int, np.ndarray]):
    """Input sorted by share and length: the candidates' blocks, then the queries' blocks."""
    def found(share: Share, waiting: list) -> pa.RecordBatch:
        q_ids, q = (np.concatenate(x) for x in zip(*waiting))
        best, _ = _nearest(k, q_ids, q, share)
        return pa.record_batch({"query_id": q_ids[best.of], "vec_id": best.ids, "score": best.scores})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, share, blocks, waiting = None, None, [], []
        for b in batches:
            for i in range(b.num_rows):
                here = b.column("share")[i].as_py(), b.column("dim")[i].as_py()
                if here != now:
                    if waiting:
                        yield found(share, waiting)
                    now, share, blocks, waiting = here, None, [], []
                if not b.column("asks")[i].as_py():
                    blocks.append(_matrix(b, i))
                    continue
                if blocks:
                    share, blocks = _share(blocks, pivots.get(here[1], np.zeros((0, here[1]))), group), []
                if share:
                    waiting.append(_matrix(b, i))
                    if sum(len(x) for x, _ in waiting) >= size:
                        yield found(share, waiting)
                        waiting = []
        if waiting:
            yield found(share, waiting)
    return run


def _pivots(whole: DataFrame, dim: int, distinct: int, scale: int) -> np.ndarray:
    """From the distinct vectors with the least hashes; rows above the hash at which enough are left stay where they are."""
    n = max(min(PIVOT_SAMPLE, SAMPLE_VALUES // max(dim, 1)), PIVOTS)
    rows = whole.filter(F.size("v") == dim).select(F.xxhash64("v").alias("h"), "v")
    if distinct > 2 * n:
        rows = rows.filter(F.col("h") < LOWEST + (1 << 64) * 2 * n // distinct)
    rows = rows.distinct().orderBy("h").limit(n).select("v").collect()
    return _spread(np.floor(scale * np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), dim)), PIVOTS)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = 10, scale: int = 1024, block: int = 1024, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_q"))
    big = float("inf")
    valid = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    queries = whole.filter("is_q and id is not null").filter(valid).select("id", "v").distinct()
    whole = whole.filter(valid)
    pack = "share int, dim int, kind string, ids binary, vecs binary"

    # One row a length: rows, and about how many distinct vectors.
    stats = whole.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("distinct")).collect()
    held = spark.sparkContext.broadcast({r.dim: _pivots(whole, r.dim, r.distinct, scale) for r in stats})

    spread = min(3 * spark.sparkContext.defaultParallelism, sum(r.n for r in stats) // LEAST)
    shares = max([1, spread, *(-(-r.n * max(r.dim, PIVOTS) // HELD) for r in stats)])
    cands = whole.select("id", "v").mapInArrow(_blocks(block, scale, shares), pack).withColumn("asks", F.lit(False))
    q = queries.mapInArrow(_blocks(query_block, scale), pack)
    q = q.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("asks", F.lit(True))
    dealt = cands.unionByName(q).repartitionById(shares, F.col("share")).sortWithinPartitions("share", "dim", "asks")
    found = dealt.mapInArrow(lambda it: _search(k, query_block, GROUP, held.value)(it), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
