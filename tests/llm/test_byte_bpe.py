import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from solstice.llm.byte_bpe import Codec, decode, encode, read_ranks

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = P.path(request.param)
    ranks = read_ranks(path)
    return path, Codec(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n  x", "The and attion to thanedble the, anea.", "été où ça — naïve", "日本語のテキスト", "👩‍👩‍👧‍👦 emoji",
    "a" * 3000, "ab" * 2000, " " * 500 + "x", "\x00\x1c\x1d\x85 ", "don't we'll I'm 12345,678", "<|endoftext|>",
    "ſupercalifragilisticexpialidocious" * 20, "́́é", "x　y z", "[" * 700,
]


def test_pieces_equal_the_library(both):
    _, codec, lib = both
    rng = random.Random(3)
    for t in TEXTS[1:] + ["".join(rng.choice("aeinrst hlo") for _ in range(rng.randrange(1, 200))) for _ in range(300)]:
        # whole texts as single pieces are the hardest case
        got = codec.encode(t) if t else []
        assert got == lib._core_bpe.encode_single_piece(t.encode()) if t else got == []


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=60))
def test_any_piece(text):
    path = P.path(FILES[0])
    codec, lib = _cached(path)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert codec.encode(text) == lib._core_bpe.encode_single_piece(text.encode())


_KEPT = {}


def _cached(path):
    if path not in _KEPT:
        ranks = read_ranks(path)
        _KEPT[path] = Codec(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _KEPT[path]


def test_texts_round_trip(spark, both):
    path, _, lib = both
    rows = [(i, t, "ids?", "decoded?") for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    out = decode(encode(df, path, P.PATTERN), path).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == lib.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table(spark):
    path = P.path(FILES[0])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(df, path, P.PATTERN), path).collect() == []


def test_unknown_id_raises(spark):
    df = spark.createDataFrame([([99999999],)], "ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode(df, P.path(FILES[0])).collect()


def test_table_equals_the_library(spark):
    path = P.path(FILES[0])
    _, lib = _cached(path)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for r in decode(encode(docs, path, P.PATTERN), path).collect():
        assert r.ids == lib.encode_ordinary(r.text)
        assert bytes(r.decoded) == r.text.encode()
