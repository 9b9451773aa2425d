"""Sessions of activity by a sweep over +1 and -1 deltas.

Every event adds one at its instant and takes one away at instant + gap. The running sum of an entity falls
to zero exactly where a pause longer than the gap begins. The sweep runs in two levels: within a bucket of time, where it
yields pieces of sessions, and over the pieces of an entity, so an entity with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import require_columns

GAP_MS = 1_800_000
#: After events of one instant are merged, an hour holds at most 3.6 million instants.
BUCKET_MS = 3_600_000


def _numbered(spans: DataFrame, part: list[str], n: str, out: str, gap_ms: int) -> DataFrame:
    """``spans`` (started_at, ended_at and ``n`` events) with the number of zero crossings before each within ``part``, as ``out``."""
    point = lambda at, kind, delta: F.struct(at.alias("instant"), F.lit(kind).alias("kind"), delta.alias("delta"))
    both = F.array(point(F.col("started_at"), 0, F.col(n)), point(F.col("ended_at") + gap_ms, 1, -F.col(n)))
    # Arrivals of an instant come before departures of the same instant: a pause of exactly the gap joins.
    run = Window.partitionBy(*part).orderBy("instant", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = spans.select(*spans.columns, F.explode(both).alias("point")).select(*spans.columns, "point.*")
    closes = ((F.col("kind") == 1) & (F.col("open") == 0)).cast("long")
    return swept.withColumn("open", F.sum("delta").over(run)).withColumn(out, F.sum(closes).over(run)).where("kind = 0").select(*spans.columns, out)


def sweep_sessions(events: DataFrame, gap_ms: int = GAP_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Sessions of ``events`` (entity STRING, at LONG, event_id LONG, optional action STRING).

    Rows with a null entity, instant or id are no events; copies of a row count once.
    A session ends where more than ``gap_ms`` pass until the entity's next event: a pause of exactly the gap does not end it.
    Events of one instant are ordered by id. Extra columns are ignored. An empty table gives no sessions.
    Result: entity, session_no (from 0), first_id, last_id, started_at, ended_at, duration_ms, n_events and, where
    ``action`` is given, actions (map of action to number of events; a null action counts under '').

    The rows are shuffled once, by entity and bucket: copies, instants, the sweep and the pieces of a bucket all stay there.
    """
    require_columns(events, ["entity", "at", "event_id"])
    action = [F.coalesce("action", F.lit("")).alias("action")] if "action" in events.columns else []
    named = ["action"] * len(action)
    place = ["entity", "bucket"]
    known = (
        events.select("entity", "at", "event_id", *action, F.floor(F.col("at") / bucket_ms).alias("bucket"))
        .where(F.col("entity").isNotNull() & F.col("at").isNotNull() & F.col("event_id").isNotNull())
        .repartition(*map(F.col, place))
        .dropDuplicates([*place, "at", "event_id"])
    )
    instants = known.groupBy(*place, "at", *named).agg(F.count("*").alias("n"), F.min("event_id").alias("low_id"), F.max("event_id").alias("high_id"))
    spans = instants.withColumns({"started_at": F.col("at"), "ended_at": F.col("at")})
    swept = _numbered(spans, place, "n", "piece", gap_ms)
    # Ids count as pairs with their instants, as one instant may come once for each action.
    kept = [
        F.min(F.struct("at", "low_id")).alias("low"), F.max(F.struct("at", "high_id")).alias("high"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.sum("n").alias("n"),
    ]
    if named:
        per_action = swept.groupBy(*place, "piece", "action").agg(*kept)
        # One entry for each action of a piece, as the result itself has.
        pieces = per_action.groupBy(*place, "piece").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
            F.collect_list(F.struct("action", F.col("n").alias("k"))).alias("acts"), F.sum("n").alias("n"),
        )
    else:
        pieces = swept.groupBy(*place, "piece").agg(*kept)
    numbered = _numbered(pieces.drop("bucket", "piece"), ["entity"], "n", "session_no", gap_ms)
    sessions = numbered.groupBy("entity", "session_no").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("n").alias("n_events"),
        *[F.flatten(F.collect_list("acts")).alias("acts") for _ in named],
    )
    # Pieces of a session name their actions again; they are added up in the row.
    total = lambda name: F.aggregate(F.filter("acts", lambda e: e["action"] == name), F.lit(0).cast("long"), lambda t, e: t + e["k"])
    names = F.array_sort(F.array_distinct(F.transform("acts", lambda e: e["action"])))
    return sessions.select(
        "entity", "session_no", F.col("low.low_id").alias("first_id"), F.col("high.high_id").alias("last_id"), "started_at", "ended_at",
        (F.col("ended_at") - F.col("started_at")).alias("duration_ms"), "n_events",
        *[F.map_from_entries(F.transform(names, lambda a: F.struct(a.alias("key"), total(a).alias("value")))).alias("actions") for _ in named],
    )
