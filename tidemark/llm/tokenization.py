"""Token ids of a whole corpus: each distinct pre-token is encoded once.

Texts are split to pre-tokens with positions inside the JVM, distinct pre-tokens are encoded by the public vocabulary, and the
ids are joined back and reassembled by position. A word of one or two ids, as most are, is one number with its position on the way. Pre-tokens that make up a fixed share of the corpus are a bounded set
and travel by broadcast, so no hot word meets a shuffle; the rest is joined by word.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import cut, require_columns

#: Pre-token pattern of the byte-level vocabulary (fixed value); (?U) gives \s, \p{L} and \p{N} their Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token is hot from this share of all pre-tokens; so there are at most 1 / HOT_SHARE hot ones.
HOT_SHARE = 1 / 20_000
#: Ids below this are packed, up to two and a position into one number.
_SMALL = 1 << 16


def tokenizer_file(name: str, path: str | None = None) -> str:
    """Place of a public vocabulary file: ``path``, the TIDEMARK_TOKENIZERS folder, or the installed package."""
    if path:
        return path
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ENCODINGS: dict = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        # Words arrive already split, so the pattern takes each of them whole.
        _ENCODINGS[path] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(path), special_tokens={})
    return _ENCODINGS[path]


def pre_tokens(docs: DataFrame) -> DataFrame:
    """Pre-tokens of ``docs`` (doc_id, text) with positions; a text without any keeps one row with a null word."""
    words = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    return docs.select("doc_id", F.posexplode_outer(words).alias("pos", "word"))


def encode_corpus(docs: DataFrame, vocabulary: str | None = None, hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id and ids ARRAY<INT> of every document of ``docs`` (doc_id, text), without special tokens.

    Null and empty texts give an empty list. The strings of special tokens are ordinary text. Repeated rows of a document count
    once; different texts under one doc_id are not expected (the result then mixes them by position). A null doc_id is one document. An empty table
    gives no rows; extra columns are ignored. ``vocabulary`` is the path of a rank file that every executor can read;
    by default the byte_bpe_50k file of the installed package or of the folder in TIDEMARK_TOKENIZERS.
    """
    require_columns(docs, ["doc_id", "text"])
    path = tokenizer_file("byte_bpe_50k.tiktoken", vocabulary)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    words = pre_tokens(docs.select("doc_id", "text"))

    def encode(batches):
        coder = _encoding(path)
        for b in batches:
            ids = [coder.encode_ordinary(w) for w in b["word"]]
            fits = [len(i) <= 2 and max(i) < _SMALL for i in ids]
            yield pd.DataFrame({
                "word": b["word"], "n": b["n"], "width": [len(i) if f else 0 for i, f in zip(ids, fits)],
                "code": [(i[0] if len(i) == 1 else i[0] * _SMALL + i[1]) if f else 0 for i, f in zip(ids, fits)],
                "ids": [None if f else i for i, f in zip(ids, fits)],
            })

    counted = words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    vocab = cut(counted.mapInPandas(encode, "word string, n long, width int, code long, ids array<int>"))
    total = vocab.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") >= F.lit(total * hot_share)
    coded = ["width", "code", "ids"]
    hot = vocab.where(is_hot).select("word", *coded)
    seen = words.join(F.broadcast(hot), "word", "left")
    placed = seen.where("width IS NOT NULL OR word IS NULL").select("doc_id", "pos", *coded)
    cold = seen.where("width IS NULL AND word IS NOT NULL").select("doc_id", "pos", "word")
    placed = placed.unionByName(cold.join(vocab.where(~is_hot).select("word", *coded), "word").select("doc_id", "pos", *coded))
    pos = F.col("pos").cast("long")
    ordered = placed.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("width") == 1, pos * _SMALL + F.col("code"))).alias("ones"),
        F.collect_list(F.when(F.col("width") == 2, pos * (_SMALL * _SMALL) + F.col("code"))).alias("twos"),
        F.collect_list(F.when(F.col("width") == 0, F.struct(pos.alias("pos"), "ids"))).alias("more"),
    )
    high, low = lambda v: F.shiftright(v, 16), lambda v: v.bitwiseAND(F.lit(_SMALL - 1)).cast("int")
    one = F.transform("ones", lambda v: F.struct(high(v).alias("pos"), F.array(low(v)).alias("ids")))
    two = F.transform("twos", lambda v: F.struct(high(high(v)).alias("pos"), F.array(low(high(v)), low(v)).alias("ids")))
    parts = ordered.select("doc_id", F.array_sort(F.concat(one, two, "more")).alias("parts"))
    # Repeated rows of a document bring a position twice, side by side.
    fresh = F.filter("parts", lambda p, i: (i == 0) | (p["pos"] != F.get("parts", i - 1)["pos"]))
    return parts.select("doc_id", F.flatten(F.transform(fresh, lambda p: p["ids"])).alias("ids"))


def decode_corpus(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, ids): the ids are joined with the token-byte table and put together by position.

    The table has one row per token of the vocabulary file, so its size is bounded by the file. Null or empty ids give an
    empty text. Unknown ids are left out. Bytes that are no UTF-8 become U+FFFD.
    """
    spark: SparkSession = encoded.sparkSession
    path = tokenizer_file("byte_bpe_50k.tiktoken", vocabulary)
    table = spark.createDataFrame(pd.DataFrame([(i, b) for b, i in _ranks(path).items()], columns=["token", "bytes"]), "token int, bytes binary")
    rows = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "token")).join(F.broadcast(table), "token", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("bytes").isNotNull(), F.struct("pos", "bytes"))))
    whole = F.aggregate(parts, F.to_binary(F.lit(""), F.lit("utf-8")), lambda acc, p: F.concat(acc, p["bytes"]))
    return rows.groupBy("doc_id").agg(F.decode(whole, "UTF-8").alias("text"))
