"""Similarity joins of sets by prefix filtering, and templates of token rows."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

#: Common items that make a key, by the items (of both together) that two similar sets of their sizes may differ in: more for few.
COMMON = {3: 0, 2: 0}


def _picks(k: int) -> Column:
    """By length, all ways to pick ``k`` of so many first places, each as one number of four bits a place."""
    return F.lit([[sum(i << 4 * j for j, i in enumerate(c)) for c in combinations(range(n), k)] or [0] for n in range(COMMON[k] + k + 1)])


def _key(n: Column | str, m: Column | str, *items: Column) -> Column:
    return F.xxhash64(F.least(n, m), F.greatest(n, m), *items)


def _links(sketches: DataFrame, threshold: float) -> DataFrame:
    """class_a < class_b and jaccard of the similar pairs of ``sketches`` (class_id, n, bits, r: numbers of the items from the rarest), each once and nothing else."""
    sizes = F.sequence(F.ceil(F.col("n") * threshold - 1e-9).cast("int"), F.floor(F.col("n") / threshold + 1e-9).cast("int"))
    shared = F.ceil((F.col("n") + F.col("m")) * ((threshold - 1e-12) / (1 + threshold)) - 1e-9).cast("int")
    keyed = sketches.withColumn("m", F.explode(sizes)).withColumn("shared", shared).where("m > 0 AND shared <= n AND shared <= m").withColumn("differ", F.col("n") + F.col("m") - 2 * F.col("shared"))
    k = F.least("shared", F.when(F.col("differ") <= COMMON[3], 3).when(F.col("differ") <= COMMON[2], 2).otherwise(1))
    keyed = keyed.withColumn("k", k).withColumn("places", F.col("n") - F.col("shared") + F.col("k"))
    picks = F.when(F.col("k") == 3, F.get(_picks(3), F.col("places"))).when(F.col("k") == 2, F.get(_picks(2), F.col("places"))).otherwise(F.sequence(F.lit(0), F.col("places") - 1))
    keyed = keyed.withColumn("pick", F.explode(picks))
    place = [F.when(F.col("k") == 1, F.col("pick")).otherwise(F.col("pick").bitwiseAND(15)), *[F.when(F.col("k") > j, F.shiftright("pick", 4 * j).bitwiseAND(15)) for j in (1, 2)]]
    key = _key("n", "m", *[F.get("r", p) for p in place]).alias("key")
    small = keyed.where("n <= m").select(key, F.col("class_id").alias("a"), F.col("bits").alias("bits_a"), F.col("r").alias("r_a"), "differ", "k", (F.col("n") == F.col("m")).alias("even"))
    large = keyed.where("n >= m").select(key, F.col("class_id").alias("b"), F.col("bits").alias("bits_b"), F.col("r").alias("r_b"))
    near = small.join(large, "key").where((F.col("a") != F.col("b")) & (~F.col("even") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= F.col("differ")))
    # The generator keeps the common items from being computed once for each use.
    near = near.select("key", "a", "b", "k", "differ", F.size("r_a").alias("n"), F.size("r_b").alias("m"), F.explode(F.array(F.array_intersect("r_a", "r_b"))).alias("c"))
    # A pair meets under each choice of its common items; the choice of the first ones holds.
    first = _key("n", "m", *[F.when(F.col("k") > j, F.get("c", F.lit(j))) for j in range(3)])
    jaccard = F.size("c") / (F.col("n") + F.col("m") - F.size("c"))
    return near.where((jaccard >= threshold - 1e-12) & (first == F.col("key"))).select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), jaccard.alias("jaccard"))


def set_similarity(sets: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``sets`` (id, items ARRAY<STRING>).

    Equal sets form one class: classes has id and class_id (smallest id). links has class_a < class_b and jaccard of all pairs of different
    sets with a Jaccard similarity of at least ``threshold``; members of a class share its links. Items are ordered from the rarest. Two
    sizes say how many items similar sets share at least, and so how many each may lack; their first k common items are then among the
    first k of each beyond those. Every such choice of k is a key of the two sizes, and within a key pairs are kept whose sketches of 31
    bits differ in no more bits than the sets may in items; the sets travel with their keys, so no pair is written but the links. Null and empty sets belong to a class but have no links.
    """
    own = sets.select("id", F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))).alias("items"))
    classes = own.groupBy("items").agg(F.min("id").alias("class_id"))
    members = own.join(classes, "items").select("id", "class_id")
    items = classes.where(F.size("items") > 0).select("class_id", F.explode("items").alias("item"))
    # Items are numbered, so that sets travel and are compared as numbers.
    rarity = cut(items.groupBy("item").agg(F.count("*").alias("freq")).withColumn("no", F.monotonically_increasing_id()))
    ranked = items.join(rarity, "item").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("freq", "no"))).alias("r")).select("class_id", F.col("r.no").alias("r"))
    bits = F.aggregate("r", F.lit(0), lambda x, i: x.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.pmod(F.hash(i), F.lit(31)))))
    sketches = cut(ranked.select("class_id", F.size("r").alias("n"), bits.alias("bits"), "r"))
    return members, _links(sketches, threshold)


def templates(rows: DataFrame, group: str, tokens: str, hole: str = "?") -> DataFrame:
    """Least general template of the token rows of each group and length: fixed tokens where all rows agree, holes elsewhere.

    Positions are compared one by one by minimum and maximum, so a group of any size needs no collected rows. Result: group,
    length, template, n_rows, n_holes.
    """
    keyed = rows.where(F.col(tokens).isNotNull()).select(group, F.size(tokens).alias("length"), F.posexplode(tokens).alias("pos", "token"))
    per = keyed.groupBy(group, "length", "pos").agg(F.min("token").alias("low"), F.max("token").alias("high"), F.count("*").alias("n_rows"))
    slot = F.struct("pos", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(hole).alias("t"))
    out = per.groupBy(group, "length").agg(F.array_sort(F.collect_list(slot)).alias("s"), F.max("n_rows").alias("n_rows"), F.count_if(F.col("low") != F.col("high")).alias("n_holes"))
    return out.select(group, "length", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("template"), "n_rows", "n_holes")


def required_overlap(n: int, threshold: float) -> int:
    """Items of a set of ``n`` that a set at the threshold must share."""
    return math.ceil(n * threshold)
