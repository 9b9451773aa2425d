"""Joins that need more than an equality: intervals, as-of, forward as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of a point and each interval of the same key that holds it (both ends included).

    Intervals are cut into buckets of ``bucket`` units, so the join is an equality on (key, bucket) and a hot key is spread over
    time. Choose the bucket near the usual length of an interval. Null keys, points or ends match nothing. The points' columns
    come first; ``key`` is not doubled, and the intervals' other columns must not clash with the points'.
    """
    cut = lambda c: F.floor(F.col(c) / bucket)
    spans = intervals.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(cut(start), cut(end))))
    hit = points.withColumn("_b", cut(at)).join(spans, [key, "_b"])
    return hit.where(F.col(at).between(F.col(start), F.col(end))).drop("_b")


def overlapping(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of the same key whose spans overlap (touching ends count), each pair once.

    Both sides are cut into buckets of time; a pair is kept only in the bucket where the later of both starts lies.
    """
    (a, b), (c, e) = left_span, right_span
    cut = lambda x: F.floor(x / bucket)
    lefts = left.where(F.col(a) <= F.col(b)).withColumn("_b", F.explode(F.sequence(cut(F.col(a)), cut(F.col(b)))))
    rights = right.where(F.col(c) <= F.col(e)).withColumn("_b", F.explode(F.sequence(cut(F.col(c)), cut(F.col(e)))))
    pairs = lefts.join(rights, [key, "_b"]).where((F.col(a) <= F.col(e)) & (F.col(c) <= F.col(b)))
    return pairs.where(F.col("_b") == cut(F.greatest(F.col(a), F.col(c)))).drop("_b")


DAY_MS = 86_400_000


def as_of(probes: DataFrame, events: DataFrame, key: str, at: str, order: str, payload: list[str], bucket: int = DAY_MS) -> DataFrame:
    """For every probe the latest event of its key at or before its instant; nulls where there is none.

    Both sides are merged, and the last event is carried forward in two levels, within a bucket of time and over the buckets of a key; so no
    pair is ever built and a hot key is spread over its buckets. Events of one instant are ordered by ``order``; an event at the probe's instant
    counts. ``payload`` names the events' columns to attach. Probes with a null key or instant get nulls.
    """
    p = probes.withColumns({"_kind": F.lit(1), "_order": F.lit(None).cast("long"), "_event": F.lit(None).cast(_payload_type(events, payload))})
    own = [F.lit(None).cast(f.dataType).alias(f.name) for f in probes.schema.fields if f.name not in (key, at)]
    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, *own, F.lit(0).alias("_kind"), F.col(order).cast("long").alias("_order"), F.struct(*payload).alias("_event")).select(p.columns)
    merged = p.unionByName(e).withColumn("_b", F.floor(F.col(at) / bucket))
    w = Window.partitionBy(key, "_b").orderBy(F.col(at), "_kind", F.col("_order")).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max_by("_event", F.when(F.col("_kind") == 0, F.struct(at, "_order")))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = merged.groupBy(key, "_b").agg(latest.alias("_l")).select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.last("_l", ignorenulls=True).over(earlier).alias("_carried"))
    within = merged.withColumn("_in", F.last("_event", ignorenulls=True).over(w)).where("_kind = 1")
    found = within.join(carry, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c")), "left").withColumn("_last", F.coalesce("_in", "_carried"))
    return found.select(*probes.columns, *[F.col(f"_last.{c}").alias(c) for c in payload])


def _payload_type(df: DataFrame, payload: list[str]):
    return df.select(F.struct(*payload).alias("s")).schema["s"].dataType


def next_event(waits: DataFrame, events: DataFrame, key: list[str], at: str, out: str, bucket: int = DAY_MS) -> DataFrame:
    """For every row of ``waits`` the earliest instant of an event of the same key at or after it (null: none).

    In two levels like ``as_of``, walking back in time. Waits with a null key or instant get null.
    """
    w = waits.withColumns({"_kind": F.lit(0), "_t": F.lit(None).cast("long")})
    own = [F.lit(None).cast(f.dataType).alias(f.name) for f in waits.schema.fields if f.name not in (*key, at)]
    e = events.select(*key, at, *own, F.lit(1).alias("_kind"), F.col(at).cast("long").alias("_t")).select(w.columns).where(F.col(at).isNotNull())
    merged = w.unionByName(e).withColumn("_b", F.floor(F.col(at) / bucket))
    # The events at or after a wait come before it.
    back = Window.partitionBy(*key, "_b").orderBy(F.col(at).desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = merged.groupBy(*key, "_b").agg(F.min("_t").alias("_m")).select(*key, "_b", F.min("_m").over(later).alias("_carried"))
    within = merged.withColumn("_in", F.min("_t").over(back)).where("_kind = 0")
    return within.join(carry, [*key, "_b"], "left").withColumn(out, F.least("_in", "_carried")).select(*waits.columns, out)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
