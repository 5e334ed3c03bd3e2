import functools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from solstice.llm import packing
from solstice.llm.queries import op13_best_fit_packing

VOCABULARY = P.path("word_bpe_49k.json")
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
TEXTS = [
    None, "", " ", "\n\n x", "The and attion's to thanedble the, anea. don't WE'LL 12345,678", "été é ́a Ἀθῆναι ΣΑΣ ΟΔΟΣ İstanbul",
    "日本語のテキスト 한국어 한", "👩‍👩‍👧‍👦 emoji", "a" * 300, "<|startoftext|> x <|endoftext|>", "x".join(SPACES), "a\x1cb \x1f c\x85d\xa0e​f　g",
    "word " * 5000, "\x00 ﻿ x", "ﬁ Ⅷ ſ K",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def cut(ids, n):
    return [ids[i : i + n] for i in range(0, len(ids), n)]


def checked(rows, limits):
    """Sequences are gapless from 0 and keep every limit; returns their number."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= limits.tokens and len(b) <= limits.documents and sum(n * n for _, n in b) <= limits.attention
    return len(bins)


def test_pieces_equal_the_library(spark, library):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, sequence_id string")
    got = {}
    out = packing.pieces(df, VOCABULARY, 1, 64)
    assert out.columns == ["doc_id", "sequence_id", "piece", "start", "length", "ids_crc32", "ids"]
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        want = cut(library(t), 64)
        have = sorted(got[i], key=lambda r: r.piece)
        assert [r.ids for r in have] == want
        assert [(r.piece, r.start, r.length) for r in have] == [(k, 64 * k, len(w)) for k, w in enumerate(want)]
        assert [r.ids_crc32 for r in have] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


def test_forgetting_words_changes_nothing(library):
    with open(VOCABULARY) as f:
        e = packing.Encoder(f.read(), max_words=4)
    for t in TEXTS[1:] * 2:
        assert np.frombuffer(e.text(t), "<u4").tolist() == library(t)[:-1]


def test_every_short_character(library):
    """Each character that skips the library's own cutting, alone and between letters and digits."""
    with open(VOCABULARY) as f:
        e = packing.Encoder(f.read())
    for c in map(chr, range(0x250)):
        for t in (c, f"a{c}B", f"1{c}'S{c}{c}", f"{c}'ll"):
            assert np.frombuffer(e.text(t), "<u4").tolist() == library(t)[:-1], hex(ord(c))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, text):
    assert np.frombuffer(_encoder().text(text), "<u4").tolist() == library(text)[:-1]


@functools.cache
def _encoder():
    with open(VOCABULARY) as f:
        return packing.Encoder(f.read())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_limit_holds(rule):
    rng = random.Random(4)
    sizes = np.array(sorted((rng.choice([1, 2, 5, 30, 70]) for _ in range(3000)), reverse=True))
    for limits in (packing.Limits(100, 9, 6000), packing.Limits(100, 100, 10000), packing.Limits(100, 1, 10000)):
        where, offset, made = packing.best_fit(sizes, limits, rule)
        rows = [type("R", (), {"sequence_id": s, "offset": o, "length": n}) for s, o, n in zip(where, offset, sizes.tolist())]
        assert checked(rows, limits) == made
        least = max(sizes.sum() / limits.tokens, len(sizes) / limits.documents, (sizes**2).sum() / limits.attention)
        assert made <= 1.25 * least + 1 or rule == "dot"


def plain(sizes, cap):
    """Best-fit by the definition, one limit."""
    left = []
    for n in sizes:
        fit = [(x - n, k) for k, x in enumerate(left) if x >= n]
        if fit:
            left[min(fit)[1]] -= n
        else:
            left.append(cap - n)
    return len(left)


def test_one_limit_is_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        sizes = np.array(sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 400))), reverse=True))
        assert packing.best_fit(sizes, packing.Limits(100, 100, 10000, (1.0, 0.0, 0.0)))[2] == plain(sizes.tolist(), 100)


def test_too_long_a_piece_raises():
    with pytest.raises(ValueError, match="limits"):
        packing.best_fit(np.array([20, 3]), packing.Limits(100, 5, 399))


def test_rounds_join_the_rests_of_groups(spark):
    rng = random.Random(6)
    rows = [(i % 7 or None, rng.choice([1, 3, 40, 55, 90])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, length long").repartition(3)
    limits = packing.Limits(100, 60, 9000)
    out = packing.pack(df, limits, group=200).collect()
    assert sorted((str(r.doc_id), r.length) for r in out) == sorted((str(a), b) for a, b in rows)
    many = checked(out, limits)
    assert many <= checked(packing.pack(df, limits, group=10**6).collect(), limits) * 1.02 + 1


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty, VOCABULARY, 1)).collect() == []
    same = spark.createDataFrame([(None, "x"), (None, "x"), (3, None)], "doc_id long, text string")
    out = packing.pack(packing.pieces(same, VOCABULARY, 1, with_ids=False)).collect()
    assert sorted((r.length, r.offset) for r in out) == [(1, 4), (2, 0), (2, 2)] and len({r.sequence_id for r in out}) == 1


def test_query_on_the_table(spark, library):
    folder = "/root/testdata/sf0.01"
    out = op13_best_fit_packing(spark, folder).collect()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for k, ids in enumerate(cut(library(r.text), 4096)):
            want.append((r.doc_id, k, 4096 * k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert checked(out, packing.Limits()) <= -(-sum(w[3] for w in want) // 4096) + 2
