import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from solstice.llm import periodic_runs as R
from solstice.llm.queries import op12_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Runs by the definition: for every period the maximal stretches, kept where no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def kept(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def best(runs):
    return min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)


def found(texts):
    first = np.cumsum([0] + [len(t) for t in texts])
    keys = np.array([1000 * r + x for r, t in enumerate(texts) for x in t], dtype=np.uint64)
    return R.find_runs(keys, first)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_runs_by_definition(texts):
    assert found(texts) == [brute(t) for t in texts]


def test_periodic_texts():
    rng = random.Random(2)
    for _ in range(150):
        t = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            t += [rng.randrange(3) for _ in range(rng.randrange(5))] + unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
        assert found([t, t[::-1]]) == [brute(t), brute(t[::-1])]


def test_long_runs():
    assert found([[7] * 20000]) == [[(0, 20000, 1)]]
    unit = list(range(4000))
    assert found([[9] + unit * 5 + [1]]) == [[(1, 20001 - 1, 4000)]]


TEXTS = [None, "", " \n ", "a", "a a a a a a", "a a a a a", "x a b a b a b a b\ta b y", "a  b\x0ba\x0cb\ra b a b a", "é é é é é é é é é é é é",
         "one two three " * 400, "\x1c \x1c \x1c \x1c \x1c \x1c end", "q w e r t y u i o p " * 3]


def check(rows):
    for r in rows:
        words = WORD.findall(r.text_ or "")
        runs = brute(words)
        assert [tuple(x) for x in r.runs] == runs
        assert (tuple(r.best_run) if r.best_run else None) == best(runs)
        assert r.collapsed == kept(words, runs)


def test_odd_texts(spark):
    df = spark.createDataFrame([(None if i % 3 else i, t, t, "clash") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, text_ string, runs string")
    out = R.with_runs(df).collect()
    assert len(out) == 2 * len(TEXTS)
    check(out)


def test_empty_table(spark):
    out = R.with_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == [] and out.columns == ["doc_id", "text", "runs", "best_run", "collapsed"]


def test_wrong_fingerprints_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(R.W, "word_hashes", lambda w: (w.ends - w.starts).astype(np.uint64))  # words of one length are taken for equal
    w = R.W.words_of(pa.array(["aa ab ac ad ae af ag ah", "aa aa aa aa aa aa ab"]))
    assert R._row_runs(w, R.W.word_hashes(w)) == {1: [(0, 6, 1)]}


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def quick(words):
    """As ``brute``, with numpy for each period."""
    ids = np.unique(np.array(words), return_inverse=True)[1] if words else np.zeros(0, int)
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([0], (ids[:-q] == ids[q:]).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = j - i + q
            if length >= max(6, 4 * q) and not any((ids[i + p : i + length] == ids[i : i + length - p]).all() for p in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = op12_periodic_runs(spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    some = 0
    for r in out:
        words = planted(WORD.findall(texts[r.doc_id] or ""), r.doc_id)
        runs = quick(words)
        some += bool(runs)
        b = best(runs)
        want = (len(runs), *(b or (None,) * 3), 1000 * b[1] // b[2] if b else None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(kept(words, runs))
    assert some > 50


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(None, "a a a a a a a"), (10, None), (11, ""), (11, "")] + [(i, "b c d e f g h i j k l m n o p") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op12_periodic_runs(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and {r.n_runs for r in out if r.doc_id is None} == {1}
    for r in out:
        if r.doc_id is not None and r.doc_id not in (10, 11):
            assert r.n_runs == len(brute(planted("b c d e f g h i j k l m n o p".split(), r.doc_id)))
