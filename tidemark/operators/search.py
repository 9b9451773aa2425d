"""Full-text search over postings: BM25 with phrase and prefix terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, tf, length) of every term of every document; ``words`` is an array of terms."""
    w = docs.select(key, words.alias("_w"))
    exploded = w.select(key, F.size("_w").alias("length"), F.explode("_w").alias("term"))
    return exploded.groupBy(key, "length", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", "length")


def bm25(posts: DataFrame, key: str, terms: list[str], prefix: bool = False) -> DataFrame:
    """Score of every document that has one of ``terms`` (or a word that begins with one).

    Robertson BM25 with k1 = 1.2, b = 0.75 and an idf of at least 1e-6. Length statistics are over all documents, so only the
    rows of matching terms meet a shuffle besides one aggregation of lengths.
    """
    hit = F.lit(False)
    for t in terms:
        hit = hit | (F.col("term").startswith(t) if prefix else F.col("term") == t)
    lengths = posts.select(key, "length").distinct().agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    picked = posts.where(hit)
    df = picked.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = picked.join(df, "term").crossJoin(F.broadcast(lengths))  # lengths is a single row
    return scored.groupBy(key).agg(F.sum(idf * part).alias("score"))
