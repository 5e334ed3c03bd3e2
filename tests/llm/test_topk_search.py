import math
import random

from pyspark.sql import functions as F

from solstice.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k=10, scale=1024):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i is not None and i % 100 == 0}:
        s = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for i, b in good if i != q and len(a) == len(b)]
        out += [(q, n, i, max(min(-t, (1 << 63) - 1), -(1 << 63))) for n, (t, _, _, i) in enumerate(sorted(s)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = top_k(df, F.col("vec_id") % 100 == 0, **kw)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def f32(x):
    import numpy as np
    return float(np.float32(x))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [f32(rng.gauss(0, 0.3)) for _ in range(8)]) for i in range(700)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block=16, query_block=2, k=3) == brute(rows, 3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0, -0.5]), (6, [1.0, -0.5]),
            (7, [1.0]), (100, [0.0, 0.0]), (200, []), (300, [2.0]), (8, [-3.0, 0.25]), (None, [1.0, -0.5]), (400, [1e30, 1.0]), (9, [])]
    rows = [(i, None if v is None else [None if x is None else f32(x) for x in v]) for i, v in rows]
    rows = [r for r in rows if r[0] != 400]
    assert run(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    rows = [(i, [0.5, 0.5, 0.5]) for i in range(40)] + [(100, [0.5, 0.5, 0.5])] * 2 + [(3, [0.5, 0.5, 0.5])]
    assert run(spark, rows) == brute(rows)


def test_huge_components_are_exact(spark):
    rows = [(0, [f32(3e6), f32(1e6)]), (1, [f32(3e6), f32(-9e6)]), (2, [f32(1.5e6), f32(1e6)]), (3, [f32(3e6), f32(1e6)])]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, None)]) == []


def test_table_equals_brute_force(spark):
    vec = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in vec.collect()]
    got = sorted((tuple(r) for r in top_k(vec, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == brute(rows)


def test_driver_sees_a_bounded_sample(spark):
    """The choice of pivots brought 2,000 rows of every task to the driver: 9 MB here, hundreds at a few GB."""
    vec = spark.range(0, 40_000, 1, 16).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.rand(3) + F.hash("id", i) / 2.0 ** 31).alias("embedding"))
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        top_k(vec, F.col("vec_id") % 100 == 0)
    finally:
        conf.set("spark.driver.maxResultSize", before)


def test_many_shares_and_small_groups(spark, monkeypatch):
    from solstice.llm import topk_search
    monkeypatch.setattr(topk_search, "HELD", 4096)
    monkeypatch.setattr(topk_search, "GROUP", 8)
    rng = random.Random(2)
    rows = [(i % 900, [f32(c + rng.gauss(0, 0.01)) for c in (i % 5, -(i % 3), i % 2)]) for i in range(1000)]
    rows = [r for n, r in enumerate(rows) if n < 900 or r[0] % 100] + [(i, [1.0, -1.0, 0.0]) for i in range(1001, 1030)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block=16, query_block=3, k=3) == brute(rows, 3)


def test_bounds_spare_far_groups():
    import numpy as np

    from solstice.llm.topk_search import _distances, _nearest, _share, _spread
    rng = np.random.default_rng(3)
    angle = np.repeat(np.arange(12) * np.pi / 6, 200)
    c = np.floor(1000 * np.stack([np.cos(angle), np.sin(angle)], axis=1) + rng.normal(0, 5, (2400, 2)))
    ids = rng.permutation(2400)
    share = _share([(ids[:1000], c[:1000]), (ids[1000:], c[1000:])], _spread(c[::7], 32), 64)
    assert np.allclose(share.least[0], _distances(share.vecs[:64], share.pivots, share.top - (share.vecs[:64].astype(float) ** 2).sum(1)).min(0))
    best, scored = _nearest(5, ids[:10], c[:10], share)
    want = [(n, v, s) for n in range(10) for s, v in sorted((-int(c[n] @ c[j]), int(ids[j])) for j in range(2400) if j != n)[:5]]
    assert [(n, v, -s) for n, v, s in zip(best.of.tolist(), best.ids.tolist(), best.scores.tolist())] == want
    assert scored < 10 * 2400 / 2


def test_one_huge_vector_among_small_ones(spark):
    """Exact integers only where floats are not: by pairs, not for all that share a task with it."""
    rng = random.Random(4)
    rows = [(i, [f32(rng.gauss(0, 0.3)) for _ in range(4)]) for i in range(300)]
    rows += [(1000, [f32(9e8), f32(-7e8), f32(5e8), f32(1e8)]), (1001, [f32(-9e8), f32(7e8), 0.0, f32(3.0)])]
    assert run(spark, rows) == brute(rows)
