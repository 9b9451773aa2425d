"""Streaming queries run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.streaming import feeds
from tidemark.streaming.jobs import job_answers
from tidemark.streaming.leases import lease_events
from tidemark.streaming.runner import run_available, stream_table

family = Family()
query = family.query
P = V.PRELUDE


@query("T3 R61", P + "SELECT id, event_type FROM x_feed WHERE id > 100 AND NOT starts_with(event_type, 'lock_') AND moment IS NOT NULL")
def tail_stream(spark, d):
    """Posts behind a cursor, each once, appended as they come."""
    return run_available(feeds.tail(stream_table(spark, f"{d}/agent_feed.parquet"), 100).select("id", "event_type"), "append")


@query("T1 T2 V8", "SELECT event_type, count(*) AS n, max(id) AS last_id FROM agent_feed GROUP BY event_type")
def status_stream(spark, d):
    """The status after all batches; each batch publishes it whole."""
    return run_available(feeds.status_snapshot(stream_table(spark, f"{d}/agent_feed.parquet")), "complete")


_SESSIONS = P + """, g AS (SELECT handle, moment, CASE WHEN moment - lag(moment) OVER (PARTITION BY handle ORDER BY moment) <= 1800000 THEN 0 ELSE 1 END AS o FROM (SELECT handle, moment FROM x_calls_raw WHERE handle IS NOT NULL AND moment IS NOT NULL)),
s AS (SELECT handle, moment, sum(o) OVER (PARTITION BY handle ORDER BY moment) AS k FROM g)
SELECT handle, min(moment) AS first_ms, max(moment) AS last_ms, count(*) AS n FROM s GROUP BY handle, k"""


@query("T17 W6", _SESSIONS.replace("x_calls_raw", f"(SELECT {N.sql_handle('agent')} AS handle, {N.sql_instant('ts')} AS moment FROM tool_calls)"))
def session_stream(spark, d):
    """Session windows over the call stream; a pause of exactly the gap joins, as the engine merges session windows that touch."""
    s = run_available(feeds.stream_sessions(stream_table(spark, f"{d}/tool_calls.parquet")), "complete")
    return s.select("handle", F.unix_millis("first_call").alias("first_ms"), F.unix_millis("last_call").alias("last_ms"), "n")


@query("T18 A18", "SELECT id, max(result_chars) AS result_chars, max(cf_chars) AS cf_chars FROM tool_calls GROUP BY id")
def maxima_stream(spark, d):
    m = feeds.keyed_maxima(stream_table(spark, f"{d}/tool_calls.parquet"), "id", ["result_chars", "cf_chars"])
    changes = run_available(m, "update")
    # Update mode gives a key again whenever it grows: the last change holds.
    return changes.groupBy("id").agg(F.max_by(F.struct("result_chars", "cf_chars"), "batch_id").alias("m")).select("id", "m.*")


@query("T5 T6 T7 T8 R11 R21 R25 R26 R27 R28")
def lease_stream(spark, d):
    """Lease events of the feed's lock requests. Keyed state has no oracle; tested against a plain fold."""
    f = stream_table(spark, f"{d}/agent_feed.parquet").where(F.col("event_type").isin("lock_queued", "lock_acquired", "lock_released"))
    at = N.instant_ms(F.col("timestamp"))
    kind = F.when(F.col("event_type") == "lock_released", "release").otherwise("request")
    requests = f.select(
        F.col("file_path").alias("file"), F.col("id").alias("seq"), at.alias("at"), kind.alias("kind"), N.handle_key(F.col("author_id")).alias("agent"),
        F.lit(0).alias("priority"), F.timestamp_millis(at).alias("ts"))
    return run_available(lease_events(requests), "append")


@query("T10 T11 T12 T13 R37")
def job_stream(spark, d):
    """Answers of a coalescing queue to the ledger's calls: a failed call is a crash of the action's job. Tested against a plain fold."""
    c = stream_table(spark, f"{d}/tool_calls.parquet")
    kinds = F.when(F.col("ok") == 0, F.lit("crash")).when(F.col("surface") == "cli", "start").otherwise("request")
    messages = c.select(
        N.handle_key(F.col("action")).alias("job"), F.col("id").alias("seq"), N.instant_ms(F.col("ts")).alias("at"), kinds.alias("kind"),
        N.handle_key(F.col("agent")).alias("requester"), F.coalesce("session", F.lit("")).alias("fingerprint"))
    return run_available(job_answers(messages), "append")


@query("T9 R25", P + "SELECT id FROM x_agents WHERE heartbeat IS NULL OR heartbeat + 2592000000 > 1775000000000")
def live_agents(spark, d, now: int = 1_775_000_000_000):
    """Agents whose heartbeat has not outlived its time."""
    a = V.agents(spark, d).withColumn("expires", F.col("heartbeat") + 30 * 86_400_000)
    return feeds.not_expired(a, "expires", now).select("id")


QUERIES = family.queries
