"""Streams over the feed and the call ledger: tails, session windows, keyed maxima, expiry, waiting for a condition."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normalize as N


def with_event_time(rows: DataFrame, at: str, out: str = "ts_event") -> DataFrame:
    """Rows with a known instant, as a timestamp column beside it."""
    return rows.withColumn("_ms", N.instant_ms(F.col(at))).where("_ms IS NOT NULL").withColumn(out, F.timestamp_millis("_ms")).drop("_ms")


def tail(feed: DataFrame, cursor: int = -1, noise: str = "lock_") -> DataFrame:
    """Posts behind a cursor, without noise; repeated rows within the watermark once. Works on streams and tables."""
    fresh = feed.where((F.col("id") > cursor) & ~F.col("event_type").startswith(noise))
    if fresh.isStreaming:
        return with_event_time(fresh, "timestamp").withWatermark("ts_event", "3650 days").dropDuplicatesWithinWatermark(["id"])
    return with_event_time(fresh, "timestamp").dropDuplicates(["id"])


def status_snapshot(feed: DataFrame) -> DataFrame:
    """Full status per kind of event after every batch (complete mode)."""
    return feed.groupBy("event_type").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def stream_sessions(calls: DataFrame, gap: str = "30 minutes", delay: str = "3650 days") -> DataFrame:
    """Sessions of tool calls by session windows: handle, first and last instant, number of calls. Late rows within ``delay`` merge sessions."""
    keyed = with_event_time(calls, "ts").withColumn("handle", N.handle_key(F.col("agent"))).where("handle IS NOT NULL")
    w = F.session_window("ts_event", gap)
    return keyed.withWatermark("ts_event", delay).groupBy("handle", w).agg(F.count("*").alias("n"), F.max("ts_event").alias("last_call")).select(
        "handle", F.col("session_window.start").alias("first_call"), "last_call", "n")


def keyed_maxima(entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-wise maximum per message id (update mode), so growing repeats of a message count once."""
    return entries.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])


def not_expired(rows: DataFrame, expires: str, now: int) -> DataFrame:
    """Rows whose time to live has not passed; without one they stay."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > now))


def wait_for(condition: Callable[[], bool], poll_s: float = 3.0, timeout_s: float = 1800.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> bool:
    """Poll a condition until it holds (True) or the time is up (False)."""
    end = clock() + timeout_s
    while True:
        if condition():
            return True
        if clock() + poll_s > end:
            return False
        sleep(poll_s)
