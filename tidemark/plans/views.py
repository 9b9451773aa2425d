"""Base views of the tables (repeated rows once, the row that holds, normal keys), and the same views as an SQL prelude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.runtime import load

TASK_COLUMNS = [
    "updated_at", "title", "description", "tier", "target_path", "status", "priority", "assigned_agent_id", "parent_id", "dependencies",
    "created_at", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "origin_type", "telemetry_source",
]
#: Task states that count as closed.
CLOSED = ["done", "duplicate", "cancelled", "deleted"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def once(rows: DataFrame, key: str) -> DataFrame:
    """Each key once; repeated rows are exact copies, so any of them will do. Columns that nobody asks for are not even read."""
    return rows.dropDuplicates([key])


def holding(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that holds of each key: greatest by ``order``. One aggregate per column, so that unused columns are pruned."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in rest])


def files(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "files"), "path")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "symbols"), "id").withColumn("path", N.path_key(F.col("file_path")))


def agents(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "agents"), "id").withColumn("handle", N.handle_key(F.col("id"))).withColumn("state", F.lower("status"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by the row that holds; handle and lower-case state beside the raw columns."""
    held = holding(load(spark, d, "agent_tasks").where("id IS NOT NULL").select("id", *TASK_COLUMNS), ["id"], ["updated_at", "status", "priority", "parent_id", "total_tokens"])
    return held.withColumns({"handle": N.handle_key(F.col("assigned_agent_id")), "state": F.lower("status")})


def feed(spark: SparkSession, d: str) -> DataFrame:
    rows = once(load(spark, d, "agent_feed"), "id")
    return rows.withColumns({"at": N.instant_ms(F.col("timestamp")), "author": N.handle_key(F.col("author_id"))})


def calls(spark: SparkSession, d: str) -> DataFrame:
    rows = once(load(spark, d, "tool_calls"), "id")
    return rows.withColumns({"at": N.instant_ms(F.col("ts")), "handle": N.handle_key(F.col("agent")), "verb": N.handle_key(F.col("action"))})


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage by the latest import of a run and agent."""
    t = load(spark, d, "task_usage").withColumn("agent_key", N.text_key(F.col("agent_id")))
    held = holding(t, ["run_id", "agent_key"], ["imported_at", "started_at", "total_tokens", "cost_usd"])
    who = N.handle_key(F.col("handle"))
    return held.withColumns({"began": N.instant_ms(F.col("started_at")), "ended": N.instant_ms(F.col("ended_at")), "who": who, "micros": F.round(F.col("cost_usd") * 1e6).cast("long")})


def fills(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "blueprint_fills"), "fill_id").withColumn("bp", N.text_key(F.col("blueprint_id")))


def blueprints(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "blueprints"), "id").withColumn("bp", N.text_key(F.col("id")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 64-dimensional unit vectors of the embeddings table."""
    return load(spark, d, "embeddings")


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Findings, for which orders stand in: one row per order, its customer as the file."""
    o = load(spark, d, "orders")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("vid"), F.concat(F.lit("c/"), F.pmod("o_custkey", F.lit(7)), F.lit("/"), F.col("o_custkey")).alias("file_path"),
        F.col("o_custkey").alias("file_no"),
        F.concat(F.lit("RULE_"), F.pmod("o_orderkey", F.lit(13))).alias("rule"),
        F.element_at(F.array(*map(F.lit, SEVERITIES)), rank).alias("severity"),
        F.concat(F.lit("PILLAR_"), F.pmod("o_orderkey", F.lit(11)) + 1).alias("pillar"),
        (F.pmod("o_orderkey", F.lit(400)) + 1).alias("line"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("found_on"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Dependency edges of tasks (src depends on dst): parents and the JSON list of dependencies; both ends exist."""
    t = tasks(spark, d)
    listed = t.select(F.col("id").alias("src"), F.explode(F.coalesce(F.from_json("dependencies", "array<bigint>"), F.array().cast("array<bigint>"))).alias("dst"))
    up = t.where("parent_id IS NOT NULL AND parent_id <> 0").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    known = t.select(F.col("id").alias("dst"))
    return listed.union(up).where("src <> dst").distinct().join(known, "dst", "left_semi").select("src", "dst")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents: doc_id, doc_kind, path, line (from 1), text. CR before LF belongs to the break."""
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "doc_kind", "path", F.posexplode(F.split("text", "\r?\n")).alias("i", "text"))
    return docs.select("doc_id", "doc_kind", "path", (F.col("i") + 1).cast("long").alias("line"), "text")


_TASK_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in TASK_COLUMNS)

PRELUDE = f"""
WITH RECURSIVE
x_files AS (SELECT DISTINCT * FROM files),
x_symbols AS (SELECT DISTINCT *, {N.sql_path('file_path')} AS path FROM symbols),
x_agents AS (SELECT DISTINCT *, {N.sql_handle('id')} AS handle, lower(status) AS state FROM agents),
x_tasks AS (SELECT * EXCLUDE (k), {N.sql_handle('assigned_agent_id')} AS handle, lower(status) AS state FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_TASK_ORDER}) AS k FROM agent_tasks WHERE id IS NOT NULL) WHERE k = 1),
x_feed AS (SELECT *, {N.sql_instant('"timestamp"')} AS moment, {N.sql_handle('author_id')} AS author FROM (SELECT DISTINCT * FROM agent_feed)),
x_calls AS (SELECT *, {N.sql_instant('ts')} AS moment, {N.sql_handle('agent')} AS handle, {N.sql_handle('action')} AS verb FROM (SELECT DISTINCT * FROM tool_calls)),
x_usage AS (SELECT * EXCLUDE (k), {N.sql_instant('started_at')} AS began, {N.sql_instant('ended_at')} AS ended, {N.sql_handle('handle')} AS who,
  CAST(round(cost_usd * 1e6) AS BIGINT) AS micros FROM (
  SELECT *, {N.sql_text_key('agent_id')} AS agent_key, row_number() OVER (PARTITION BY run_id, {N.sql_text_key('agent_id')} ORDER BY imported_at DESC NULLS LAST) AS k FROM task_usage) WHERE k = 1),
x_fills AS (SELECT DISTINCT *, {N.sql_text_key('blueprint_id')} AS bp FROM blueprint_fills),
x_blueprints AS (SELECT DISTINCT *, {N.sql_text_key('id')} AS bp FROM blueprints),
x_violations AS (SELECT o_orderkey AS vid, 'c/' || (o_custkey % 7) || '/' || o_custkey AS file_path, o_custkey AS file_no, 'RULE_' || (o_orderkey % 13) AS rule,
  (['CRITICAL','HIGH','MEDIUM','LOW','INFO'])[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS severity, 'PILLAR_' || (o_orderkey % 11 + 1) AS pillar,
  o_orderkey % 400 + 1 AS line, o_orderstatus AS state, o_orderdate AS found_on FROM orders),
x_edges AS (SELECT DISTINCT e.src, e.dst FROM (SELECT id AS src, unnest(CAST(json(dependencies) AS BIGINT[])) AS dst FROM x_tasks WHERE json_valid(dependencies)
  UNION ALL SELECT id, parent_id FROM x_tasks WHERE parent_id <> 0) e WHERE e.src <> e.dst AND e.dst IN (SELECT id FROM x_tasks)),
x_lines AS (SELECT doc_id, doc_kind, path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (
  SELECT doc_id, doc_kind, path, string_split_regex(text, '\\r?\\n') AS parts FROM documents WHERE text IS NOT NULL))
"""
