"""Board and merge operators: id remapping, ledgers of merged rows, compare-and-set, latest stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.operators.windows import last_n
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.runtime import load

family = Family()
query = family.query
P = V.PRELUDE


@query("R42 R31", P + """, m AS (SELECT id, row_number() OVER (ORDER BY id) + 100000 AS fresh FROM x_tasks WHERE priority = 1), d AS (SELECT id, unnest(range(1, len(deps) + 1)) AS pos, unnest(deps) AS dep FROM (SELECT id, CAST(json(dependencies) AS BIGINT[]) AS deps FROM x_tasks WHERE json_valid(dependencies)))
SELECT d.id, '[' || string_agg(coalesce('h' || m.id, CAST(d.dep AS VARCHAR)), ',' ORDER BY pos) || ']' AS remapped FROM d LEFT JOIN m ON m.id = d.dep GROUP BY d.id""")
def remapped_dependencies(spark, d):
    """Ids inside dependency lists replaced where a mapping has them; others stay. The mapping is joined, never collected."""
    t = V.tasks(spark, d)
    mapping = t.where("priority = 1").select(F.col("id").alias("dep"), F.concat(F.lit("h"), "id").alias("fresh"))
    items = t.select("id", F.posexplode(F.from_json("dependencies", "array<bigint>")).alias("pos", "dep")).join(mapping, "dep", "left")
    g = items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fresh", F.col("dep").cast("string")).alias("v")))).alias("l"))
    return g.select("id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["v"]), ","), F.lit("]")).alias("remapped"))


@query("R43", P + "SELECT id, '{\"run\":' || (CAST(json_extract_string(metadata, '$.run') AS BIGINT) + 1000) || '}' AS metadata FROM x_feed WHERE json_valid(metadata) AND json_extract_string(metadata, '$.run') IS NOT NULL")
def rekeyed_metadata(spark, d):
    run = F.get_json_object("metadata", "$.run").cast("long")
    return V.feed(spark, d).where(run.isNotNull()).select("id", F.to_json(F.struct((run + 1000).alias("run"))).alias("metadata"))


@query("R44 R45", P + "SELECT run_id, agent_key FROM x_usage u WHERE agent_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x_tasks t WHERE t.id = u.task_id) AND imported_at > (SELECT quantile_cont(imported_at, 0.5) FROM x_usage)")
def unmerged_rows(spark, d):
    """Rows that no ledger entry covers and that were written after the last merge (here: after the median import)."""
    u = V.usage(spark, d)
    mark = F.broadcast(u.agg(F.percentile("imported_at", F.lit(0.5)).alias("mark")))  # a single row
    ledger = V.tasks(spark, d).select(F.col("id").alias("task_id"))
    late = u.where("agent_key IS NOT NULL").join(mark, F.col("imported_at") > F.col("mark"))
    return late.join(ledger, "task_id", "left_anti").select("run_id", "agent_key")


@query("R37", P + "SELECT task_id, arg_min(author, (moment, id)) AS winner, count(DISTINCT author) AS n_claimants FROM x_feed WHERE event_type = 'task_status_updated' AND task_id IS NOT NULL AND author IS NOT NULL AND moment IS NOT NULL GROUP BY task_id")
def claim_winners(spark, d):
    """Compare-and-set by events: the first claimant of each task wins."""
    f = V.feed(spark, d).where("event_type = 'task_status_updated' AND task_id IS NOT NULL AND author IS NOT NULL AND at IS NOT NULL")
    return f.groupBy("task_id").agg(F.min_by("author", F.struct("at", "id")).alias("winner"), F.count_distinct("author").alias("n_claimants"))


@query("R56", P + "SELECT author, id FROM (SELECT author, id, row_number() OVER (PARTITION BY author ORDER BY id DESC) AS r FROM x_feed WHERE author IS NOT NULL) WHERE r <= 50")
def newest_kept(spark, d):
    """The newest fifty events of every author: what a trim keeps."""
    return last_n(V.feed(spark, d).where("author IS NOT NULL"), ["author"], [F.desc("id")], 50).select("author", "id")


@query("R57", P + "SELECT 'blocked' AS source, CAST(id AS VARCHAR) AS key FROM x_tasks WHERE state = 'blocked' UNION ALL SELECT 'waiting', CAST(id AS VARCHAR) FROM x_feed WHERE event_type = 'lock_queued' UNION ALL SELECT 'invalid', CAST(fill_id AS VARCHAR) FROM x_fills WHERE valid = 0")
def attention_inbox(spark, d):
    parts = [
        V.tasks(spark, d).where("state = 'blocked'").select(F.lit("blocked").alias("source"), F.col("id").cast("string").alias("key")),
        V.feed(spark, d).where("event_type = 'lock_queued'").select(F.lit("waiting").alias("source"), F.col("id").cast("string").alias("key")),
        V.fills(spark, d).where("valid = 0").select(F.lit("invalid").alias("source"), F.col("fill_id").cast("string").alias("key")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("R46 R47", P + "SELECT value AS pattern, count(*) AS times, max(filled_at) AS last_seen FROM x_fills WHERE valid = 1 AND value IS NOT NULL GROUP BY value")
def learning_counters(spark, d):
    f = V.fills(spark, d).where("valid = 1 AND value IS NOT NULL")
    return f.groupBy(F.col("value").alias("pattern")).agg(F.count("*").alias("times"), F.max("filled_at").alias("last_seen"))


@query("R16", P + """SELECT u.run_id, u.agent_key, count(*) AS n_commits FROM x_usage u JOIN x_feed f ON f.author = u.who AND f.event_type = 'commit' AND f.moment BETWEEN u.began AND u.ended + 604800000 WHERE u.agent_key IS NOT NULL GROUP BY u.run_id, u.agent_key""")
def commits_in_runs(spark, d, slack_ms: int = 604_800_000):
    """Commits of a handle inside its run window, a week of slack at the end."""
    from tidemark.operators.joins import point_in_interval

    u = V.usage(spark, d).where("agent_key IS NOT NULL AND who IS NOT NULL AND began IS NOT NULL AND ended IS NOT NULL")
    spans = u.select("run_id", "agent_key", F.col("who").alias("author"), "began", (F.col("ended") + slack_ms).alias("until"))
    commits = V.feed(spark, d).where("event_type = 'commit' AND author IS NOT NULL AND at IS NOT NULL").select("author", "at")
    return point_in_interval(commits, spans, "author", "at", "began", "until", slack_ms).groupBy("run_id", "agent_key").agg(F.count("*").alias("n_commits"))


@query("R8", P + "SELECT run_id FROM (SELECT DISTINCT run_id FROM x_usage WHERE starts_with(run_id, 'run-1')) ORDER BY run_id LIMIT 2")
def run_prefix(spark, d, prefix: str = "run-1"):
    """Runs of an id prefix; two rows mean that it is ambiguous."""
    return V.usage(spark, d).where(F.col("run_id").startswith(prefix)).select("run_id").distinct().orderBy("run_id").limit(2)


@query("R32", P + "SELECT arg_max(id, (updated_seq, id)) AS latest, count(*) FILTER (lower(status) = 'planned') AS n_pending, count(*) FILTER (lower(status) = 'applied') AS n_applied FROM x_blueprints")
def release_state(spark, d):
    s = F.lower("status")
    return V.blueprints(spark, d).agg(F.max_by("id", F.struct("updated_seq", "id")).alias("latest"), F.count_if(s == "planned").alias("n_pending"), F.count_if(s == "applied").alias("n_applied"))


@query("R13 R1", P + "SELECT count(*) = 0 AS is_empty FROM x_files")
def emptiness_probe(spark, d):
    return spark.createDataFrame([(load(spark, d, "files").isEmpty(),)], "is_empty boolean")


@query("R54", P + "SELECT file_path, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS n_blocking FROM x_violations GROUP BY file_path")
def blocking_counts(spark, d):
    return V.violations(spark, d).groupBy("file_path").agg(F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("n_blocking"))


@query("R36 S26", P + "SELECT id, coalesce(tier, '') AS tier, coalesce(priority, 2) AS priority, coalesce(cost_usd, 0) AS cost_usd, coalesce(dependencies, '[]') AS dependencies FROM x_tasks")
def tasks_with_defaults(spark, d):
    t = V.tasks(spark, d)
    return t.select("id", F.coalesce("tier", F.lit("")).alias("tier"), F.coalesce("priority", F.lit(2)).alias("priority"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("dependencies", F.lit("[]")).alias("dependencies"))


@query("R29", P + "SELECT DISTINCT q.file_path, q.author FROM x_feed q WHERE q.event_type = 'lock_queued' AND q.author IS NOT NULL AND q.file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x_feed n WHERE n.event_type = 'lock_acquired' AND n.author = q.author AND n.file_path = q.file_path)")
def unanswered_waiters(spark, d):
    f = V.feed(spark, d)
    got = f.where("event_type = 'lock_acquired'").select("file_path", "author")
    return f.where("event_type = 'lock_queued' AND author IS NOT NULL AND file_path IS NOT NULL").join(got, ["file_path", "author"], "left_anti").select("file_path", "author").distinct()


@query("S20", P + "SELECT s.id FROM x_symbols s WHERE s.path IN (SELECT path FROM x_files WHERE content_hash IS NOT NULL)")
def seeded_rows(spark, d):
    """Symbol rows that a new checkout could take over, by files whose content hash is known."""
    from tidemark.sources.store import seed_from

    stamps = V.files(spark, d).where("content_hash IS NOT NULL").select("path")
    return seed_from(V.symbols(spark, d), stamps, ["path"]).select("id")


@query("N1 X24", P + "SELECT id, " + N.sql_handle("recipient_id") + " AS recipient, read_at IS NOT NULL AS is_read FROM x_feed WHERE recipient_id IS NOT NULL")
def inbox(spark, d):
    f = V.feed(spark, d).where("recipient_id IS NOT NULL")
    return f.select("id", N.handle_key(F.col("recipient_id")).alias("recipient"), F.col("read_at").isNotNull().alias("is_read"))


QUERIES = family.queries
