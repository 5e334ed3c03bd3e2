"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

* **Random indexing.**  A token (a run of letters and digits, lower-cased, or a
  run of one other sign, each with its shape: lower, Title, UPPER, …) falls by
  hash into one of ``BUCKETS`` rows.  Each row has a fixed sparse random index
  vector (``SEEDS`` entries of +1 or -1 among ``DIM``).  A row's context vector
  is the sum of the index vectors of the tokens within ``REACH`` places, over
  **all documents**: tasks add up whole matrices, their blocks are added in
  streams, and the finished matrix has ``BUCKETS * DIM`` numbers whatever the
  input's size, so it may be collected and broadcast.
* **Pooling.**  A document's features are the mean and the standard deviation
  of its tokens' vectors (a row's own index vector and its context vector, each
  of unit length).
* **Network.**  Two layers, in numpy on the driver, fitted on at most
  ``MAX_ROWS`` labelled documents (those with the smallest hashes).  A fixed
  fifth of them is held back to choose the epoch and to fit the temperature
  that divides the logit.  Classes are weighted to equal sums while fitting;
  the temperature step then shifts the logit to the real odds.
* **Scoring** is one pass without a shuffle.

Only the text is read for features; labels come from a table of (id, label).

Defined cases: null, empty or blank text: all features 0, and the score that
the network gives for them.  No usable labels, or labels of one class only:
every score is that class's share (0.5 without labels).  Null ids or labels
don't train; repeated label rows count as often as they occur.  Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solstice.llm import words as W

BUCKETS, DIM, SEEDS, REACH = 1 << 14, 32, 4, 2
#: Rows of the matrix that travel together.
BLOCK = 256
#: Labelled documents used for fitting, hidden units, epochs, seed of the network.
MAX_ROWS, HIDDEN, EPOCHS, SEED = 20_000, 32, 60, 7
FEATURES = 4 * DIM
#: Bytes of text, and tokens of a document, handled at once.
PART, RUN = 1 << 20, 4096

# Byte classes: 0 blank, 1 letter, digit or part of a longer character, 2 + k other signs.
_KIND = np.full(256, 1, dtype=np.int16)
_KIND[:0x21] = 0
for _b in [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]:
    _KIND[_b] = 2 + _b
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _index_places() -> np.ndarray:
    """SEEDS x BUCKETS: twice the place of a row's entry in its index vector, plus 1 for a -1."""
    rows = np.arange(BUCKETS)
    h = np.stack([W.mix((rows * SEEDS + k + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in range(SEEDS)])
    return (h >> np.uint64(8)).astype(np.int64) % DIM * 2 + (h & np.uint64(1)).astype(np.int64)


PLACES = _index_places()


def _signed(counts: np.ndarray) -> np.ndarray:
    """Counts of +1 and -1 entries (rows x 2 DIM) as sums (rows x DIM)."""
    pairs = counts.reshape(-1, DIM, 2)
    return pairs[:, :, 0] - pairs[:, :, 1]


#: The fixed sparse random index vector of every row.
INDEX = sum(_signed(np.bincount(np.arange(BUCKETS) * 2 * DIM + p, minlength=BUCKETS * 2 * DIM)) for p in PLACES)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, first token of each row and the end)."""
    data, offsets = W.text_buffers(texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    cut = np.flatnonzero(start)
    ends = np.append(cut[1:], n)
    solid = kind[cut] != 0
    starts, ends = cut[solid], ends[solid]
    length = ends - starts
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    digit = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    n_up, n_dig = upper[ends] - upper[starts], digit[ends] - digit[starts]
    first_up = _UPPER[data[starts]] if len(starts) else np.zeros(0, bool)
    shape = np.where(n_up == length, np.where(length > 1, 3, 1), np.where(n_up == 0, 0, np.where(first_up & (n_up == 1), 1, 2)))
    shape = np.where(n_dig == length, 4, np.where(n_dig > 0, 5, shape))
    h = W.span_hashes(W._LOWER[data], starts, ends) ^ W.mix(shape.astype(np.uint64) + np.uint64(11))
    return (W.mix(h) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def _add_contexts(total: np.ndarray, t: np.ndarray, first: np.ndarray) -> None:
    """Adds to ``total`` (flat, rows x 2 DIM) the +1 and -1 entries of the tokens within REACH places in the same document."""
    if len(t) < 2:
        return
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for step in range(1, REACH + 1):
        same = doc[step:] == doc[:-step]
        a, b = t[:-step][same], t[step:][same]
        for p in PLACES:
            total += np.bincount(a * (2 * DIM) + p[b], minlength=BUCKETS * 2 * DIM)
            total += np.bincount(b * (2 * DIM) + p[a], minlength=BUCKETS * 2 * DIM)


def _context_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * 2 * DIM, dtype=np.int64)
    for whole in batches:
        for b in W.slices(whole, "text", PART):
            _add_contexts(total, *tokens(b.column("text")))
    yield from _as_blocks(_signed(total))


def _as_blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    live = [k for k in range(BUCKETS // BLOCK) if total[k * BLOCK : (k + 1) * BLOCK].any()]
    if live:
        yield pa.record_batch({"block": pa.array(live, pa.int32()),
                               "sums": pa.array([total[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in live], pa.binary())})


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial blocks that reach this task, one at a time."""
    total = np.zeros((BUCKETS, DIM), dtype=np.int64)
    for b in batches:
        for k, s in zip(b.column("block").to_pylist(), b.column("sums")):
            total[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(s.as_buffer(), dtype=np.int64).reshape(BLOCK, DIM)
    yield from _as_blocks(total)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Vectors from all texts: own index vector and context vector, each of unit length, and their squares."""
    blocks = texts.mapInArrow(W.giving_back(_context_blocks), "block int, sums binary").repartition("block").mapInArrow(_add_blocks, "block int, sums binary")
    total = np.zeros((BUCKETS, DIM), dtype=np.float64)
    for r in blocks.collect():  # BUCKETS x DIM numbers in all
        total[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, dtype=np.int64).reshape(BLOCK, DIM)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return _squared(np.hstack((unit(INDEX.astype(np.float64)), unit(total))))


def _squared(vectors: np.ndarray) -> np.ndarray:
    """The vectors and their squares side by side."""
    return np.hstack((vectors, vectors * vectors)).astype(np.float32)


def pooled(texts: pa.Array, squared: np.ndarray) -> np.ndarray:
    """Features of each text: mean and standard deviation of its tokens' vectors (``_squared`` ones)."""
    t, first = tokens(texts)
    out = np.zeros((len(first) - 1, FEATURES), dtype=np.float64)
    rows, ones = np.empty((RUN, FEATURES), dtype=np.float32), np.ones(RUN, dtype=np.float32)
    for i, (a, z) in enumerate(zip(first.tolist(), first[1:].tolist())):
        for k in range(a, z, RUN):
            n = min(RUN, z - k)
            np.take(squared, t[k : k + n], axis=0, out=rows[:n])
            out[i] += ones[:n] @ rows[:n]
        if z > a:
            out[i] /= z - a
    half = FEATURES // 2
    out[:, half:] = np.sqrt(np.maximum(out[:, half:] - out[:, :half] ** 2, 0))
    return out


class Network:
    """standardise -> tanh layer -> logit, divided by a temperature and shifted."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0
        self.mean, self.sd, self.temperature, self.shift = np.zeros(FEATURES), np.ones(FEATURES), 1.0, 0.0
        self.constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.sd @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (self.logit(x) + self.shift) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> "Network":
        if not len(y) or y.min() == y.max() or not (~held).any():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        xt, yt = x[~held], y[~held]
        if yt.min() == yt.max() or not held.any():
            xt, yt, held = x, y, np.ones(len(y), dtype=bool)
        self.mean, self.sd = xt.mean(0), xt.std(0) + 1e-6
        share = yt.mean()
        weight = np.where(yt == 1, 0.5 / share, 0.5 / (1 - share))
        rng, params = np.random.default_rng(SEED), ["w1", "b1", "w2", "b2"]
        m, s, step, best = {p: 0.0 for p in params}, {p: 0.0 for p in params}, 0, (np.inf, None)
        xs = (xt - self.mean) / self.sd
        for _ in range(EPOCHS):
            order = rng.permutation(len(yt))
            for a in range(0, len(order), 64):
                i = order[a : a + 64]
                h = np.tanh(xs[i] @ self.w1 + self.b1)
                g = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40))) - yt[i]) * weight[i] / len(i)
                back = np.outer(g, self.w2) * (1 - h * h)
                grads = {"w2": h.T @ g + 1e-4 * self.w2, "b2": g.sum(), "w1": xs[i].T @ back + 1e-4 * self.w1, "b1": back.sum(0)}
                step += 1
                for p in params:  # Adam
                    m[p] = 0.9 * m[p] + 0.1 * grads[p]
                    s[p] = 0.999 * s[p] + 0.001 * grads[p] ** 2
                    setattr(self, p, getattr(self, p) - 0.003 * (m[p] / (1 - 0.9 ** step)) / (np.sqrt(s[p] / (1 - 0.999 ** step)) + 1e-8))
            loss = _log_loss(self.logit(x[held]), y[held])
            if loss < best[0]:
                best = (loss, {p: np.copy(getattr(self, p)) for p in params})
        for p, v in best[1].items():
            setattr(self, p, v if v.ndim else float(v))
        z = self.logit(x[held])
        odds = float(np.log(share / (1 - share)))
        grid = [(_log_loss((z + c) / t, y[held]), t, c) for t in np.exp(np.linspace(-1.5, 1.5, 25)) for c in (0.0, odds / 2, odds)]
        _, self.temperature, self.shift = min(grid)
        return self


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors from all ``docs`` and a network from a bounded sample of the labelled ones."""
    spark = docs.sparkSession
    vectors = word_vectors(docs.select(F.col(text_col).alias("text")))
    kept = (labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("y"))
            .filter(F.col("key").isNotNull() & F.col("y").isin(0, 1)).orderBy(F.xxhash64("key"), "key", "y").limit(MAX_ROWS))
    held = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, "text", PART):
                x = pooled(b.column("text"), held.value)
                yield pa.record_batch({"key": b.column("key"), "y": b.column("y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(kept), "key").select("key", "y", "text").mapInArrow(run, "key long, y int, x binary").collect()
    rows.sort(key=lambda r: (r.key, r.y, r.x))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), FEATURES)
    y = np.array([r.y for r in rows], dtype=np.float64)
    back = np.array([zlib.crc32(b"validate:%d" % r.key) % 5 == 0 for r in rows], dtype=bool)
    return vectors, Network().fit(x, y, back)


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = held.value
        for whole in batches:
            for b in W.slices(whole, "text", PART):
                yield pa.record_batch({"id": b.column("id"), "score": pa.array(net.score(pooled(b.column("text"), vectors)), pa.float64())})

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(W.giving_back(run), "id long, score double").withColumnRenamed("id", id_col)


def score_rows(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row with all its columns and ``score_col`` (replaced if it is there)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != score_col]
    fields = [f for f in docs.schema.fields if f.name != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = held.value
        for whole in batches:
            for b in W.slices(whole, text_col, PART):
                s = pa.array(net.score(pooled(b.column(text_col), vectors)), pa.float64())
                yield pa.record_batch([*[b.column(c) for c in names], s], names=[*names, score_col])

    return docs.select(*names).mapInArrow(W.giving_back(run), T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))
