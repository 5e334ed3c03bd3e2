import re

import pytest

from solstice.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, n_words string, kept_text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Windows in document order; a word is removed when a window over it was seen earlier."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if k in seen:
                gone[i:i + window] = [True] * window
            seen.add(k)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = remove_repeats(df, **kw).collect()
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got]


def words(a, b, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(a, b))


CASES = [
    (1, words(0, 50)), (2, words(10, 45) + "  tail\tx"), (3, None), (4, ""), (5, " \n\t "),
    (6, "a " * 70), (7, words(0, 50)), (8, words(0, 19)), (9, words(5, 24)), (10, words(5, 25)),
    (11, "é ü " + words(20, 41) + " é ü"), (None, words(30, 50)), (12, words(100, 900)),
    (13, words(90, 300) + " " + words(100, 180)), (14, words(0, 10) + " " + words(0, 10) + " " + words(0, 10)),
]


@pytest.mark.parametrize("window,gram", [(20, 6), (3, 3), (7, 2)])
def test_equals_brute_force(spark, window, gram):
    want = brute(CASES, window)
    got = run(spark, CASES, window=window, gram=gram)
    assert len(got) == len(CASES)
    for d, *rest in got:
        assert tuple(rest) == want[d], d


def test_repeated_rows_and_shared_ids(spark):
    t = words(0, 30)
    got = run(spark, [(1, t), (1, t), (2, t)])
    assert sorted(got) == [(1, 30, 0, t), (1, 30, 0, t), (2, 30, 30, "")]
    other = t + " end"
    kept = sorted(g[2] for g in run(spark, [(1, t), (1, other)]))
    assert kept in ([0, 30],)  # one of the two texts keeps the passage


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_text_spans_hash_blocks(spark):
    body = " ".join(f"k{i}" for i in range(300_000))
    got = {r[0]: r[1:3] for r in run(spark, [(1, body), (2, "x" * 3_000_000 + " " + body)])}
    assert got == {1: (300_000, 0), 2: (300_001, 300_000)}


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs).collect()}
    assert got == want
    assert sum(v[1] for v in got.values()) > 0
