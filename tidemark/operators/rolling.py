"""Totals over trailing periods of days, inactive days included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import require_columns


def trailing_totals(facts: DataFrame, measures: list[str], periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing sums and averages per entity and day of ``facts`` (entity, day INT as a day number, ``measures``).

    Rows are first merged to daily totals (a null measure adds 0 and the day still counts as active; rows with a null
    entity or day are left out). Calendar rows of zero fill the days between an entity's first and last active day. Each
    period of N days is a RANGE frame over the day number, its average has the fixed denominator N. An empty table gives
    no rows; extra columns are ignored.
    Result: entity, day, active, day_index (1 on the first active day), <m>, <m>_sum_<N>d and <m>_avg_<N>d.
    """
    require_columns(facts, ["entity", "day", *measures])
    daily = (
        facts.where(F.col("entity").isNotNull() & F.col("day").isNotNull())
        .groupBy("entity", "day").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
    )
    spans = daily.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    calendar = spans.select(
        "entity", F.explode(F.sequence("first_day", "last_day")).alias("day"),
        *[F.lit(0).cast(daily.schema[m].dataType).alias(m) for m in measures], F.lit(0).alias("active"),
    )
    days = (
        daily.withColumn("active", F.lit(1)).unionByName(calendar)
        .groupBy("entity", "day").agg(F.max("active").alias("active"), *[F.sum(m).alias(m) for m in measures])
    )
    whole = Window.partitionBy("entity").orderBy("day")
    out = days.withColumn("day_index", F.col("day") - F.first("day").over(whole) + 1)
    for n in periods:
        frame = whole.rangeBetween(-(n - 1), 0)
        for m in measures:
            total = F.sum(m).over(frame)
            out = out.withColumns({f"{m}_sum_{n}d": total, f"{m}_avg_{n}d": total / F.lit(float(n))})
    return out.withColumn("active", F.col("active") == 1)
