import random
import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from solstice.llm.byte_bpe import read_ranks
from tests.llm.test_jaccard_join import brute as jaccard_groups
from tests.llm.test_pii import brute as base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small folder with a junk document, copies, a leak, personal data, nulls and odd columns."""
    rng = random.Random(12)
    common = "the of and to in a is that it was".split()
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else f"word{rng.randrange(3000)}" for _ in range(n))
    good = [text(rng.randrange(60, 200)) for _ in range(80)]
    junk = ["!! ".join(text(100).upper().split()) + "!!" for _ in range(30)]
    item = text(30)
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, t) for i, t in enumerate(junk)]
    rows += [(200, good[0]), (201, good[0] + " tail"), (202, good[1]), (202, good[1]), (203, text(20) + " " + item + " " + text(20)),
             (204, text(50) + " mail me@host.example.com or +1 (269) 555-3296"), (205, None), (206, ""), (None, text(90)), (None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "clash", "clash") for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(80)] + [(100 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in C.STAGES:
        out.append(docs := C.stored(stage(spark, docs, sf), "test"))
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(steps, spark, sf):
    want = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(df.columns == want for df in steps[:-1])


def test_quality_rejects_junk_only(steps):
    left = {i for i, _ in rows_of(steps[0])}
    assert not left & set(range(100, 130)) and left >= set(range(80)) | {200, 201, 202, 203, 204}


def test_one_of_each_group_stays(steps):
    before, after = rows_of(steps[0]), rows_of(steps[1])
    numbered = [(k, t) for k, (_, t) in enumerate(sorted(set(before), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))]
    groups = {c for _, _, c in jaccard_groups(numbered, 5, 80)}
    assert len(after) == len(groups)
    assert {0, 1} <= {i for i, _ in after} and not {200, 201, 202} & {i for i, _ in after}


def test_the_leak_goes(steps):
    assert set(rows_of(steps[1])) - set(rows_of(steps[2])) == {r for r in rows_of(steps[1]) if r[0] == 203}


def test_personal_data_is_replaced(steps):
    before, after = dict(rows_of(steps[2])), dict(rows_of(steps[3]))
    assert len(steps[3].collect()) == len(steps[2].collect())
    assert after[204].endswith("mail [EMAIL] or [PHONE]")
    for i, t in before.items():
        if not base_spans(t):
            assert after[i] == t
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in steps[3].collect())


def test_tokens_equal_the_library(steps):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(C.RANKS)), special_tokens={})
    texts = sorted((lib.encode_ordinary(t or "") for _, t in rows_of(steps[3])))
    got = steps[4].collect()
    assert sorted(list(r.ids) for r in got) == texts
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_run_equals_the_stages(spark, sf, steps):
    key = lambda r: (str(r.doc_id), list(r.ids))
    assert sorted(map(key, C.run(spark, sf).collect())) == sorted(map(key, steps[-1].collect()))


def test_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_clean_documents_stay(spark):
    """On the given tables: labelled good documents stay, exact copies go, planted passages go."""
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {i for i, _ in rows_of(C.quality_filter(spark, docs, path))}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    good, bad = [i for i, q in truth.items() if q == 1], [i for i, q in truth.items() if q == 0]
    assert sum(i in kept for i in good) > 0.98 * len(good)
    assert sum(i in kept for i in bad) < 0.15 * len(bad)
    items = [" ".join(re.findall(r"\w+", r.text)) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rest = rows_of(C.decontaminate(spark, docs, path))
    assert len(rest) > 0.9 * docs.count()
    for _, t in rest:
        flat = " ".join(re.findall(r"\w+", t or ""))
        assert not any(i in flat for i in items)
