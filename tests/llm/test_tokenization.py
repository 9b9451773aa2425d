from __future__ import annotations

import pytest

from tidemark.llm.tokenization import decode_corpus, encode_corpus

TEXTS = [
    "", None, " ", "Hello world", "it's we'll I'M", "tabs\t\tand\n\nlines\r\n  x", "1234 12a a12", "naïve café ñ", "漢字かな交じり文", "emoji 🧪✅ → 👩‍👩‍👧", "nbsp  x　y z w",
    "<|endoftext|> is text", "a​b⁠c﻿", "Привет, мир!", "é combining", "  leading", "trailing   ", "\x00\x01\x1c\x1f\x85", "_under_score__", "ｗｉｄｅ", "½²③Ⅷ", "x" * 30_000, "word " * 8_000, "مرحبا بالعالم",
]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_equals_the_tokenizer(spark, tokenizer):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_hot_and_cold_words_give_the_same(spark, tokenizer, share):
    texts = ["a b a b a c", "b c", "rare"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, hot_share=share).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_positions_beyond_the_packed_range(spark, tokenizer):
    text = "a b antidisestablishmentarianism " * 15_000
    got = encode_corpus(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["ids"]
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_repeated_rows_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z"), (2, None), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: len(r["ids"]) for r in encode_corpus(df).collect()}
    assert got == {1: 2, None: 1, 2: 0}
    assert encode_corpus(df.limit(0)).collect() == []


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decode_corpus(encode_corpus(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_decode_unknown_ids(spark):
    df = spark.createDataFrame([(1, [999_999, 31373]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode_corpus(df).collect()} == {1: "hello", 2: ""}


def test_missing_vocabulary(spark):
    with pytest.raises(FileNotFoundError):
        encode_corpus(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "/none/here.tiktoken")
