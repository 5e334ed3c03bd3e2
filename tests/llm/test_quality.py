import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from solstice.llm import quality as Q

SF = "/root/testdata/sf0.1"


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_context_sums_equal_a_plain_loop():
    texts = ["the cat sat!!! on The mat", "", "a", "the cat", None, "X1 22 été $$$ $$"]
    t, first = Q.tokens(pa.array(texts, pa.string()))
    want = np.zeros((Q.BUCKETS, Q.DIM), dtype=np.int64)
    for a, z in zip(first, first[1:]):
        for i in range(a, z):
            for j in range(a, z):
                if i != j and abs(i - j) <= Q.REACH:
                    want[t[i]] += Q.INDEX[t[j]]
    got = np.zeros(Q.BUCKETS * 2 * Q.DIM, dtype=np.int64)
    Q._add_contexts(got, t, first)
    assert (Q._signed(got) == want).all()


def test_tokens_and_shapes():
    t, first = Q.tokens(pa.array(["cat CAT Cat cat !! !!! é", "cat"]))
    assert list(first) == [0, 7, 8]
    assert t[0] == t[3] == t[7] and len({t[0], t[1], t[2]}) == 3 and t[4] != t[5]


def test_pooling_equals_numpy():
    vectors = np.random.default_rng(0).normal(size=(Q.BUCKETS, 2 * Q.DIM)).astype(np.float32)
    texts = pa.array(["a b c a a", "", "b"])
    t, first = Q.tokens(texts)
    got = Q.pooled(texts, Q._squared(vectors))
    v = vectors[t[first[0]:first[1]]].astype(float)
    assert np.allclose(got[0], np.hstack((v.mean(0), v.std(0))), atol=1e-3)
    assert not got[1].any()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    train = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    got = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, train)).collect()}
    assert len(got) == docs.count()
    test = [(got[d], y) for d, y in truth.items() if is_held(d)]
    assert np.mean([(s >= 0.5) == y for s, y in test]) > 0.97
    good, bad = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    loss = -np.mean([math.log(max(s if y else 1 - s, 1e-9)) for s, y in test])
    assert loss < 0.15  # calibrated, not only ranked


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, y string, x string"
    rows = [(1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (None, "good words", "a", "b", "c"), (4, "x" * 200_000, "a", "b", "c"), (4, " \n", "a", "b", "c")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, 1), (4, None)], "doc_id long, quality int")
    for use in (labels, labels.limit(0), labels.filter("quality = 1")):
        model = Q.fit(docs, use)
        out = Q.score(docs, model).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
        assert len(Q.score_rows(docs, model).columns) == 5
    empty = docs.limit(0)
    assert Q.score(empty, Q.fit(empty, labels)).collect() == []
    assert Q.fit(docs, labels.limit(0))[1].constant == pytest.approx(0.5)
