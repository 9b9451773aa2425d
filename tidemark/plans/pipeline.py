"""Registered queries of the general training-data problems (2, 4, 5 and 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.operators.hierarchy import all_descendants, resolve_hierarchy
from tidemark.operators.references import broken_references, reference_report
from tidemark.operators.rolling import trailing_totals
from tidemark.operators.sessions import GAP_MS, sweep_sessions
from tidemark.runtime import load

# ---- problem 2: sessions of tool calls


def _calls(spark: SparkSession, d: str, with_actions: bool) -> DataFrame:
    t = load(spark, d, "tool_calls")
    action = [F.coalesce(N.handle_key(F.col("action")), F.lit("")).alias("action")] if with_actions else []
    return t.select(
        N.handle_key(F.col("agent")).alias("entity"), N.instant_ms(F.col("ts")).alias("at"), F.col("id").alias("event_id"), *action
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sweep_sessions(_calls(spark, d, False)).select(F.col("entity").alias("agent"), "first_id", "last_id")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sweep_sessions(_calls(spark, d, True))
    per_action = F.array_join(
        F.transform(F.array_sort(F.map_entries("actions")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return s.select(
        F.col("entity").alias("agent"), "first_id", "last_id", "started_at", "ended_at", "duration_ms",
        F.col("n_events").alias("n_calls"), per_action.alias("calls_per_action"),
    )


_SQL_SESSIONS = f"""
WITH calls AS (
  SELECT id, min({N.sql_handle('agent')}) AS agent, min({N.sql_instant('ts')}) AS moment, min(coalesce({N.sql_handle('action')}, '')) AS action
  FROM tool_calls WHERE id IS NOT NULL GROUP BY id),
gaps AS (SELECT *, CASE WHEN moment - lag(moment) OVER w > {GAP_MS} THEN 1 ELSE 0 END AS opens FROM calls
  WHERE agent IS NOT NULL AND moment IS NOT NULL WINDOW w AS (PARTITION BY agent ORDER BY moment, id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY agent ORDER BY moment, id ROWS UNBOUNDED PRECEDING) AS s FROM gaps),
ends AS (SELECT agent, s, min(moment) AS started_at, max(moment) AS ended_at, count(*) AS n_calls,
  arg_min(id, (moment, id)) AS first_id, arg_max(id, (moment, id)) AS last_id FROM numbered GROUP BY agent, s)
"""
P2_FOUND = _SQL_SESSIONS + "SELECT agent, first_id, last_id FROM ends"
P2_SESSIONS = _SQL_SESSIONS + """,
acts AS (SELECT agent, s, string_agg(action || '=' || k, ',' ORDER BY action) AS calls_per_action
  FROM (SELECT agent, s, action, count(*) AS k FROM numbered GROUP BY agent, s, action) GROUP BY agent, s)
SELECT e.agent, first_id, last_id, started_at, ended_at, ended_at - started_at AS duration_ms, n_calls, calls_per_action
FROM ends e JOIN acts a ON a.agent = e.agent AND a.s = e.s"""

# ---- problem 4: the task hierarchy


def holding_tasks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per task: the one with the latest updated_at; null ids are no tasks."""
    picked = [c for c in dict.fromkeys(["updated_at", *columns]) if c != "id"]
    t = load(spark, d, "agent_tasks").where("id IS NOT NULL").select("id", *picked)
    return t.groupBy("id").agg(F.max(F.struct(*picked)).alias("row")).select("id", "row.*")


def _task_nodes(spark: SparkSession, d: str) -> DataFrame:
    return holding_tasks(spark, d, "parent_id").select("id", N.id_key(F.col("parent_id")).alias("parent_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(_task_nodes(spark, d)).select("id", "root_id", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    r = resolve_hierarchy(_task_nodes(spark, d), with_paths=True)
    return r.select("id", "root_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every task, those on and below loops included."""
    return all_descendants(_task_nodes(spark, d))


_SQL_TASKS = """
WITH RECURSIVE held AS (SELECT id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY updated_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS k FROM agent_tasks WHERE id IS NOT NULL) WHERE k = 1),
nodes AS (SELECT h.id, p.id AS up FROM held h LEFT JOIN held p ON p.id = h.parent_id AND h.parent_id <> 0),
tree AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(id AS VARCHAR) AS path FROM nodes WHERE up IS NULL
  UNION ALL SELECT n.id, t.root_id, t.depth + 1, t.path || '/' || n.id FROM tree t JOIN nodes n ON n.up = t.id),
stuck AS (SELECT id, up FROM nodes WHERE id NOT IN (SELECT id FROM tree)),
walk AS (SELECT id, up FROM stuck UNION SELECT w.id, s.up FROM walk w JOIN stuck s ON s.id = w.up),
ring AS (SELECT w.id, min(w.up) AS low FROM walk w WHERE w.id IN (SELECT id FROM walk WHERE id = up) GROUP BY w.id),
"""
P4_FOUND = _SQL_TASKS + """
looped AS (SELECT s.id, min(r.low) AS root_id FROM stuck s JOIN walk w ON w.id = s.id JOIN ring r ON r.id = w.up GROUP BY s.id)
SELECT id, root_id, depth FROM tree UNION ALL SELECT id, root_id, CAST(-1 AS BIGINT) FROM looped"""
P4_PATHS = P4_FOUND.replace("SELECT id, root_id, depth FROM tree UNION ALL SELECT id, root_id, CAST(-1 AS BIGINT) FROM looped",
                            "SELECT id, root_id, depth, path FROM tree UNION ALL SELECT id, root_id, CAST(-1 AS BIGINT), NULL FROM looped")
P4_DESCENDANTS = _SQL_TASKS + """
pairs AS (SELECT id AS ancestor_id, id, CAST(0 AS BIGINT) AS distance FROM tree
  UNION ALL SELECT p.ancestor_id, n.id, p.distance + 1 FROM pairs p JOIN nodes n ON n.up = p.id),
climbs AS (SELECT id, id AS ancestor_id, CAST(0 AS BIGINT) AS distance, [id] AS seen FROM stuck
  UNION ALL SELECT c.id, s.up, c.distance + 1, list_append(c.seen, s.up) FROM climbs c JOIN stuck s ON s.id = c.ancestor_id WHERE NOT list_contains(c.seen, s.up))
SELECT ancestor_id, id, distance FROM pairs UNION ALL SELECT ancestor_id, id, distance FROM climbs"""

# ---- problem 5: rolling usage


def _usage_days(spark: SparkSession, d: str) -> DataFrame:
    """Usage rows that hold: of one run and agent the latest import; a null run is a run of its own name."""
    t = load(spark, d, "task_usage").select(
        F.coalesce("run_id", F.lit("")).alias("run_id"), N.text_key(F.col("agent_id")).alias("entity"),
        "imported_at", "started_at", "total_tokens", "cost_usd",
    )
    held = t.where("entity IS NOT NULL").groupBy("run_id", "entity").agg(
        F.max(F.struct("imported_at", "started_at", "total_tokens", "cost_usd")).alias("row")
    )
    day = N.day_number(N.instant_ms(F.col("row.started_at")))
    # Whole millionths, so that sums do not depend on the order of addition.
    micros = F.round(F.col("row.cost_usd") * 1e6).cast("long")
    return held.select("entity", day.alias("day"), "row.total_tokens", micros.alias("cost_micros"))


def _rolling(spark: SparkSession, d: str, measures: list[str]) -> DataFrame:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))
    return (
        trailing_totals(_usage_days(spark, d), measures)
        .withColumnRenamed("entity", "agent_id").withColumn("usage_day", F.date_format(day, "yyyy-MM-dd"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    r = _rolling(spark, d, ["total_tokens"])
    return r.where("day_index >= 30 AND 2 * total_tokens_sum_7d > total_tokens_sum_30d").select("agent_id", "usage_day")


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = _rolling(spark, d, ["total_tokens", "cost_micros"])
    money = [(F.col(c) / F.lit(1e6)).alias(c.replace("cost_micros", "cost_usd")) for c in r.columns if c.startswith("cost_micros")]
    tokens = [c for c in r.columns if c.startswith("total_tokens")]
    return r.select("agent_id", "usage_day", "active", *tokens, *money)


_SQL_ROLLING = f"""
WITH held AS (SELECT agent, started_at, total_tokens, cost_usd FROM (
    SELECT *, {N.sql_text_key('agent_id')} AS agent, row_number() OVER (PARTITION BY coalesce(run_id, ''), {N.sql_text_key('agent_id')}
      ORDER BY imported_at DESC NULLS LAST, started_at DESC NULLS LAST, total_tokens DESC NULLS LAST, cost_usd DESC NULLS LAST) AS k
    FROM task_usage) WHERE k = 1 AND agent IS NOT NULL),
facts AS (SELECT agent, CAST(floor({N.sql_instant('started_at')} / 86400000.0) AS BIGINT) AS day, total_tokens, CAST(round(cost_usd * 1e6) AS BIGINT) AS cost_micros FROM held),
daily AS (SELECT agent, day, coalesce(sum(total_tokens), 0) AS tokens, coalesce(sum(cost_micros), 0) AS cost FROM facts WHERE day IS NOT NULL GROUP BY agent, day),
spans AS (SELECT agent, min(day) AS a, max(day) AS b FROM daily GROUP BY agent),
cal AS (SELECT agent, a, unnest(range(a, b + 1)) AS day FROM spans),
days AS (SELECT c.agent, c.day, c.day - c.a + 1 AS day_index, d.day IS NOT NULL AS active, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost
  FROM cal c LEFT JOIN daily d ON d.agent = c.agent AND d.day = c.day),
sums AS (SELECT *, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS usage_day,
  sum(tokens) OVER w7 AS t7, sum(tokens) OVER w30 AS t30, sum(cost) OVER w7 AS c7, sum(cost) OVER w30 AS c30 FROM days
  WINDOW w7 AS (PARTITION BY agent ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY agent ORDER BY day ROWS 29 PRECEDING))
"""
P5_FOUND = _SQL_ROLLING + "SELECT agent AS agent_id, usage_day FROM sums WHERE day_index >= 30 AND 2 * t7 > t30"
P5_ROLLING = _SQL_ROLLING + """
SELECT agent AS agent_id, usage_day, active, CAST(tokens AS BIGINT) AS total_tokens, CAST(t7 AS BIGINT) AS total_tokens_sum_7d,
  t7 / 7.0 AS total_tokens_avg_7d, CAST(t30 AS BIGINT) AS total_tokens_sum_30d, t30 / 30.0 AS total_tokens_avg_30d,
  cost / 1e6 AS cost_usd, c7 / 1e6 AS cost_usd_sum_7d, c7 / 7.0 / 1e6 AS cost_usd_avg_7d,
  c30 / 1e6 AS cost_usd_sum_30d, c30 / 30.0 / 1e6 AS cost_usd_avg_30d FROM sums"""

# ---- problem 6: broken references


def _deleted(c: str) -> F.Column:
    return F.coalesce(F.lower(N.trim_unicode(F.col(c))) == "deleted", F.lit(False))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "files").select(N.path_key(F.col("path")).alias("ref"), F.lit(False).alias("deleted"))
    agents = load(spark, d, "agents").select(N.handle_key(F.col("id")).alias("ref"), _deleted("status").alias("deleted"))
    held = holding_tasks(spark, d, "status", "created_at", "assigned_agent_id")
    tasks = held.select(F.col("id").alias("ref"), _deleted("status").alias("deleted"), N.instant_ms(F.col("created_at")).alias("created_at"))
    prints = load(spark, d, "blueprints").select(N.text_key(F.col("id")).alias("ref"), _deleted("status").alias("deleted"))

    def rows(table: DataFrame, key: str, ref: F.Column, when: str, *more: F.Column) -> DataFrame:
        return table.select(F.col(key).cast("string").alias("row_key"), ref.alias("ref"), N.month_of(N.instant_ms(F.col(when))).alias("period"), *more).where("row_key IS NOT NULL")

    symbols = rows(load(spark, d, "symbols"), "id", N.path_key(F.col("file_path")), "indexed_at").distinct()
    assigned = rows(held, "id", N.handle_key(F.col("assigned_agent_id")), "created_at")
    feed = rows(load(spark, d, "agent_feed"), "id", N.id_key(F.col("task_id")), "timestamp", N.instant_ms(F.col("timestamp")).alias("at")).distinct()
    fills = rows(load(spark, d, "blueprint_fills"), "fill_id", N.text_key(F.col("blueprint_id")), "filled_at").distinct()
    parts = {
        "symbols": broken_references(symbols, files), "agent_tasks": broken_references(assigned, agents),
        "agent_feed": broken_references(feed, tasks), "blueprint_fills": broken_references(fills, prints),
    }
    return reduce(DataFrame.unionByName, [
        part.select(F.lit(name).alias("ref_table"), "row_key", F.col("ref").cast("string").alias("ref"), "kind", "period") for name, part in parts.items()
    ])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("ref_table", "row_key", "kind", "period")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return reference_report(_broken(spark, d), ["ref_table", "period", "kind"])


_HELD = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST) AS k
  FROM agent_tasks WHERE id IS NOT NULL) WHERE k = 1)"""
_DEL = "coalesce(lower({0}) = 'deleted', false)"
_SQL_BROKEN = f"""
WITH held AS {_HELD},
parents AS (
  SELECT 'symbols' AS t, {N.sql_path('path')} AS ref, false AS gone, NULL AS born FROM files
  UNION ALL SELECT 'agent_tasks', {N.sql_handle('id')}, {_DEL.format(N.sql_trim('status'))}, NULL FROM agents
  UNION ALL SELECT 'agent_feed', CAST(id AS VARCHAR), {_DEL.format(N.sql_trim('status'))}, {N.sql_instant('created_at')} FROM held
  UNION ALL SELECT 'blueprint_fills', {N.sql_text_key('id')}, {_DEL.format(N.sql_trim('status'))}, NULL FROM blueprints),
records AS (SELECT t, ref, bool_and(gone) AS gone, min(born) AS born FROM parents WHERE ref IS NOT NULL GROUP BY t, ref),
refs AS (
  SELECT 'symbols' AS t, CAST(id AS VARCHAR) AS row_key, {N.sql_path('file_path')} AS ref, {N.sql_instant('indexed_at')} AS at FROM symbols
  UNION SELECT 'agent_tasks', CAST(id AS VARCHAR), {N.sql_handle('assigned_agent_id')}, {N.sql_instant('created_at')} FROM held
  UNION SELECT 'agent_feed', CAST(id AS VARCHAR), CAST(nullif(task_id, 0) AS VARCHAR), {N.sql_instant('timestamp')} FROM agent_feed
  UNION SELECT 'blueprint_fills', CAST(fill_id AS VARCHAR), {N.sql_text_key('blueprint_id')}, {N.sql_instant('filled_at')} FROM blueprint_fills),
found AS (SELECT c.t AS ref_table, c.row_key, c.ref, {N.sql_month('c.at')} AS period,
    CASE WHEN p.ref IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.born > c.at THEN 'late' END AS kind
  FROM refs c LEFT JOIN records p ON p.t = c.t AND p.ref = c.ref WHERE c.ref IS NOT NULL AND c.row_key IS NOT NULL)
"""
P6_FOUND = _SQL_BROKEN + "SELECT ref_table, row_key, kind, period FROM found WHERE kind IS NOT NULL"
P6_REPORT = _SQL_BROKEN + """SELECT ref_table, period, kind, count(*) AS n_rows, count(DISTINCT ref) AS n_keys
FROM found WHERE kind IS NOT NULL GROUP BY ref_table, period, kind"""

QUERIES = {
    "p2_found": (p2_found, P2_FOUND), "p2_sessions": (p2_sessions, P2_SESSIONS),
    "p4_found": (p4_found, P4_FOUND), "p4_paths": (p4_paths, P4_PATHS), "p4_descendants": (p4_descendants, P4_DESCENDANTS),
    "p5_found": (p5_found, P5_FOUND), "p5_rolling": (p5_rolling, P5_ROLLING),
    "p6_found": (p6_found, P6_FOUND), "p6_report": (p6_report, P6_REPORT),
}
