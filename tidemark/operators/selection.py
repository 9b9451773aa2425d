"""Greedy choices of disjoint spans, without a sequential pass over a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import overlapping
from tidemark.runtime import cut


def first_disjoint(spans: DataFrame, group: str, ident: str, start: str, end: str) -> DataFrame:
    """Spans that a walk in order of (start, id) takes, each beginning at or after the end of the one taken before.

    Every span points at the first one that may follow it; the chain from a group's first span is then found by doubling jumps, in
    rounds logarithmic in its length. Ids are unique; spans with a null or an end not after the start are left out. Result: group, id.
    """
    own = spans.where(F.col(group).isNotNull() & F.col(ident).isNotNull() & (F.col(start) < F.col(end))).select(
        F.col(group).alias("g"), F.col(ident).cast("long").alias("i"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    asks = own.select("g", "i", F.col("e").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("struct<s:bigint,i:bigint>").alias("x"))
    offers = own.select("g", F.lit(None).cast("long").alias("i"), F.col("s").alias("at"), F.lit(1).alias("kind"), F.struct("s", "i").alias("x"))
    back = Window.partitionBy("g").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    jump = cut(asks.unionByName(offers).withColumn("n", F.min("x").over(back)).where("kind = 0 AND n IS NOT NULL").select("i", F.col("n.i").alias("n")))
    taken = cut(own.groupBy("g").agg(F.min(F.struct("s", "i")).alias("f")).select("g", F.col("f.i").alias("i")))
    pieces, fresh = [taken], taken
    while True:
        # Jumps of length 2^k lead from the first 2^k spans of every chain to its next 2^k.
        fresh = cut(reduce(DataFrame.unionByName, pieces).join(jump, "i").select("g", F.col("n").alias("i")))
        if fresh.isEmpty():
            break
        pieces.append(fresh)
        jump = cut(jump.join(jump.select(F.col("i").alias("n"), F.col("n").alias("far")), "n").select("i", F.col("far").alias("n")))
    return reduce(DataFrame.unionByName, pieces).select(F.col("g").alias(group), F.col("i").alias(ident))


def heaviest_disjoint(spans: DataFrame, group: str, ident: str, start: str, end: str, weight: str, bucket: int) -> DataFrame:
    """Spans that a walk from the heaviest (then the smallest id) takes, each disjoint from all taken before (touching ends are disjoint).

    In every round the spans that are heavier than all they overlap are taken and what they overlap is dropped, which gives the
    same choice. ``bucket`` is a usual span length. Ids are unique; spans with a null or an end not after the start are left out.
    """
    left = cut(spans.where(F.col(group).isNotNull() & F.col(ident).isNotNull() & F.col(weight).isNotNull() & (F.col(start) < F.col(end))).select(
        F.col(group).alias("g"), F.col(ident).alias("i"), F.col(start).alias("s"), (F.col(end) - 1).alias("e"), F.col(weight).alias("w")))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        other = left.select("g", F.col("i").alias("oi"), F.col("s").alias("os"), F.col("e").alias("oe"), F.col("w").alias("ow"))
        meets = cut(overlapping(left, other, "g", ("s", "e"), ("os", "oe"), bucket).where("i <> oi").select("i", "oi", ((F.col("ow") > F.col("w")) | ((F.col("ow") == F.col("w")) & (F.col("oi") < F.col("i")))).alias("beaten")))
        top = cut(left.join(meets.where("beaten").select("i"), "i", "left_anti"))
        taken.append(top.select("g", "i"))
        gone = meets.join(top.select("i"), "i", "left_semi").select(F.col("oi").alias("i"))
        left = cut(left.join(top.select("i"), "i", "left_anti").join(gone, "i", "left_anti"))
    out = reduce(DataFrame.unionByName, taken) if taken else left.select("g", "i")
    return out.select(F.col("g").alias(group), F.col("i").alias(ident))
