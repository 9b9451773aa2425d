"""Window-shaped operators: islands, merged intervals, gap sessions, rank fusion, trailing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(df: DataFrame, keys: list[str], value: Column, out: str, total) -> DataFrame:
    """Aggregate ``total`` of ``value`` over all earlier buckets (_b) of a key, one row per key and bucket."""
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*keys, "_b").agg(total(value).alias("_v")).select(*keys, "_b", total("_v").over(earlier).alias(out))


def merge_intervals(spans: DataFrame, keys: list[str], start: str, end: str, bucket: int = 86_400_000) -> DataFrame:
    """Union of overlapping or touching intervals per key; null keys or ends are left out. Result: keys, start, end, n_merged.

    The running maximum of ends and the count of islands are taken in two levels, within a bucket of starts and over the buckets of a key, so a
    hot key is spread over its buckets.
    """
    s = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    for k in keys:
        s = s.where(F.col(k).isNotNull())
    s = s.select(*keys, start, end).withColumn("_b", F.floor(F.col(start) / bucket))
    w = Window.partitionBy(*keys, "_b").orderBy(start, end)
    reach = s.withColumn("_in", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))).join(_before(s, keys, F.col(end), "_far", F.max), [*keys, "_b"])
    far = F.greatest("_in", "_far")
    marked = reach.withColumn("_new", F.when(far.isNull() | (F.col(start) > far), 1).otherwise(0)).drop("_in", "_far")
    # Equal intervals are peers: whichever of them opened the island, all belong to it.
    local = marked.withColumn("_n", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = local.join(_before(marked, keys, F.col("_new"), "_past", F.sum), [*keys, "_b"]).withColumn("_island", F.col("_n") + F.coalesce("_past", F.lit(0)))
    return placed.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def gap_sessions(rows: DataFrame, keys: list[str], at: str, order: str, gap: int) -> DataFrame:
    """``rows`` with session_no: a new session starts where the gap to the row before is not strictly below ``gap``."""
    w = Window.partitionBy(*keys).orderBy(at, order)
    opened = F.when(F.col(at) - F.lag(at).over(w) < gap, 0).otherwise(1)
    return rows.withColumn("_o", opened).withColumn("session_no", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_o")


def islands(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """``rows`` with island: the first ordinal of the run of consecutive ordinals the row belongs to (ordinals unique per key)."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    tagged = rows.withColumn("_g", F.col(ordinal) - F.row_number().over(w))
    return tagged.withColumn("island", F.min(ordinal).over(Window.partitionBy(*keys, "_g"))).drop("_g")


def k_windows(rows: DataFrame, keys: list[str], ordinal: str, value: str, low: int, high: int) -> DataFrame:
    """All windows of ``low`` to ``high`` consecutive rows inside islands: keys, first ordinal, window_size, window_key (values joined)."""
    runs = islands(rows, keys, ordinal)
    w = Window.partitionBy(*keys, "island").orderBy(ordinal)
    ahead = F.collect_list(value).over(w.rowsBetween(0, high - 1))
    sized = runs.select(*keys, ordinal, ahead.alias("_v")).withColumn("window_size", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return sized.where(F.size("_v") >= F.col("window_size")).select(*keys, ordinal, "window_size", F.array_join(F.slice("_v", 1, F.col("window_size")), ",").alias("window_key"))


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def reciprocal_rank_fusion(rankers: list[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """Fused score of ranked lists (key, rank): sum of 1 / (constant + rank), with each list's rank beside it."""
    out = None
    for i, r in enumerate(rankers, 1):
        one = r.groupBy(key).agg(F.min("rank").alias(f"rank_{i}"))
        out = one if out is None else out.join(one, key, "full_outer")
    score = sum((F.coalesce(1.0 / (constant + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(1, len(rankers) + 1)), F.lit(0.0))
    return out.withColumn("score", score)


def context_rows(rows: DataFrame, keys: list[str], ordinal: str, hit: Column, before: int, after: int) -> DataFrame:
    """Rows within ``before`` rows ahead of or ``after`` rows behind a hit of the same key, with is_hit."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    flagged = rows.withColumn("is_hit", F.coalesce(hit, F.lit(False)))
    near = F.max("is_hit").over(w.rowsBetween(-after, before))
    return flagged.withColumn("_n", near).where("_n").drop("_n")
