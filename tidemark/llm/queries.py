"""Registered queries of the llm problems (1, 3, 7, 8 and 9) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.llm.conversations import rebuild_conversations
from tidemark.llm.language import document_languages, language_segments, mislabelled
from tidemark.llm.leakage import leaked_items, leaked_passages, remove_leaked
from tidemark.llm.tokenization import decode_corpus, encode_corpus
from tidemark.llm.vectors import similar_vectors
from tidemark.runtime import cut, load

# ---- problem 1: conversations


def _messages(spark: SparkSession, d: str) -> DataFrame:
    feed = load(spark, d, "agent_feed").where("id IS NOT NULL")
    author = N.handle_key(F.col("author_id"))
    role = (
        F.when(author == "system", "system")
        .when((author == "user") | author.startswith("user-"), "user").otherwise("assistant")
    )
    rows = feed.select(
        "thread_id", F.col("id").alias("message_id"), N.instant_ms(F.col("timestamp")).alias("at"), author.alias("author"),
        role.alias("role"), N.visible(F.col("message")).alias("visible"),
    )
    # The table is read once; copies of a row are left out before anything is joined.
    rows = cut(rows.groupBy("message_id").agg(F.max(F.struct("thread_id", "at", "author", "role", "visible")).alias("m")).select("message_id", "m.*"))
    threads = rows.where("thread_id IS NOT NULL").select(F.col("thread_id").alias("conversation")).distinct()
    inside = rows.where("thread_id IS NOT NULL").withColumnRenamed("thread_id", "conversation")
    opening = rows.drop("thread_id").join(threads, F.col("message_id") == F.col("conversation"))
    return inside.withColumn("opening", F.col("message_id") == F.col("conversation")).unionByName(opening.withColumn("opening", F.lit(True)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    conversations, _ = rebuild_conversations(_messages(spark, d))
    return conversations.where("broken").select(F.col("conversation").alias("thread_id"))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    conversations, placed = rebuild_conversations(_messages(spark, d))
    kept = conversations.where("NOT broken").select("conversation")
    return placed.join(kept, "conversation").select(F.col("conversation").alias("thread_id"), "position", "message_id", "role", "author", "at")


_SQL_CHAT = f"""
WITH feed AS (SELECT id, any_value(thread_id) AS thread_id, any_value({N.sql_instant('"timestamp"')}) AS moment, any_value({N.sql_handle('author_id')}) AS author,
    any_value(coalesce(regexp_replace(message, '[{N.SPACE_RE2}{N.INVISIBLE}]+', '', 'g') <> '', false)) AS visible FROM agent_feed WHERE id IS NOT NULL GROUP BY id),
threads AS (SELECT DISTINCT thread_id AS t FROM feed WHERE thread_id IS NOT NULL),
members AS (SELECT t, f.* FROM threads JOIN feed f ON f.thread_id = t UNION SELECT t, f.* FROM threads JOIN feed f ON f.id = t),
msgs AS (SELECT *, CASE WHEN author = 'system' THEN 'system' WHEN author = 'user' OR author LIKE 'user-%' THEN 'user' ELSE 'assistant' END AS role FROM members),
judged AS (SELECT t, bool_or(id = t) AS opened, bool_or(visible AND (moment IS NULL OR author IS NULL)) AS bad,
    arg_min(role, (moment, id)) FILTER (visible AND role <> 'system' AND moment IS NOT NULL) AS first_role,
    arg_max(role, (moment, id)) FILTER (visible AND role <> 'system' AND moment IS NOT NULL) AS last_role FROM msgs GROUP BY t),
verdict AS (SELECT t, NOT opened OR bad OR first_role IS NULL OR first_role <> 'user' OR last_role <> 'assistant' AS broken FROM judged)
"""
P1_FOUND = _SQL_CHAT + "SELECT t AS thread_id FROM verdict WHERE broken"
P1_CONVERSATIONS = _SQL_CHAT + """
SELECT m.t AS thread_id, row_number() OVER (PARTITION BY m.t ORDER BY moment, id) - 1 AS "position", id AS message_id, role, author, moment AS "at"
FROM msgs m JOIN verdict v ON v.t = m.t WHERE NOT broken AND visible"""

# ---- problem 3: similar vectors


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar others of every usable vector, of any similarity."""
    table = load(spark, d, "code_embeddings")
    near = similar_vectors(table.select("id", "vector"))
    names = table.where("id IS NOT NULL").groupBy("id").agg(F.min("target_name").alias("target_name")).select(F.col("id").alias("other_id"), "target_name")
    return near.join(names, "other_id").select("id", "other_id", "target_name", F.round("similarity", 3).alias("similarity"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = similar_vectors(load(spark, d, "code_embeddings").select("id", "vector"), least=0.8)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


_SQL_NEAR = """
WITH usable AS (SELECT id, min(list_transform(vector, lambda x: CAST(x AS DOUBLE))) AS v, min(target_name) AS target_name FROM code_embeddings
  WHERE id IS NOT NULL AND len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
pairs AS (SELECT a.id, b.id AS other_id, b.target_name, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM usable a JOIN usable b ON a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other_id) AS rank FROM pairs)
"""
P3_NEIGHBOURS = _SQL_NEAR + "SELECT id, other_id, target_name, round(similarity, 3) AS similarity FROM ranked WHERE rank <= 5"
P3_FOUND = _SQL_NEAR + "SELECT DISTINCT least(id, other_id) AS id_a, greatest(id, other_id) AS id_b FROM ranked WHERE rank <= 5 AND similarity >= 0.8"

# ---- problem 7: token ids


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(load(spark, d, "documents").select("doc_id", "text"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document decoded from its ids again; an empty text for null."""
    return decode_corpus(p7_ids(spark, d))


P7_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

# ---- problem 8: leaked evaluation texts


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id")


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """All places of all leaked passages."""
    return leaked_passages(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return remove_leaked(docs, _leaks(spark, d)).select("doc_id", "source", "doc_kind", "n_chars")


# ---- problem 9: languages


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "text", "lang")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mislabelled(document_languages(_texts(spark, d)))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(_texts(spark, d))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(_texts(spark, d)).drop("text")


QUERIES = {
    "p1_found": (p1_found, P1_FOUND), "p1_conversations": (p1_conversations, P1_CONVERSATIONS),
    "p3_found": (p3_found, P3_FOUND), "p3_neighbours": (p3_neighbours, P3_NEIGHBOURS),
    "p7_ids": (p7_ids, None), "p7_decoded": (p7_decoded, P7_DECODED),
    "p8_found": (p8_found, None), "p8_matches": (p8_matches, None), "p8_clean": (p8_clean, None),
    "p9_found": (p9_found, None), "p9_documents": (p9_documents, None), "p9_segments": (p9_segments, None),
}
