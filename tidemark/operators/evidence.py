"""Judging found groups against labelled items, and fingerprints of trees given as node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import resolve_hierarchy
from tidemark.runtime import cut, cut_counting, require_columns

#: Anchors an item needs covered, and the share of a group's sites that must be its own.
MIN_COVERED, MIN_DENSITY = 2, 0.25


def credit(covered, own, foreign, total, live):
    """Credit of a group for an item: 1, 0.5 or 0."""
    eligible = (covered >= MIN_COVERED) & (own >= F.lit(MIN_DENSITY) * total) & (foreign <= own) & (total > 0)
    return F.when(eligible & (foreign == 0) & (covered * 2 >= live), 1.0).when(eligible, 0.5).otherwise(0.0)


def score_groups(sites: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every group that touches an item: group_id, item_id, class, covered, own, foreign, total, live, credit.

    ``sites``: group_id, site, file, line; ``anchors``: item_id, class (A: to be found, B: not to be found), anchor, file, low, high. A site touches an
    item if it lies on a line of one of its anchors. covered: anchors of the item that sites of the group touch; own: sites that touch the
    item; foreign: sites that touch items, but not this one; live: anchors of the item. Copies count once; nulls touch nothing.
    """
    require_columns(sites, ["group_id", "site", "file", "line"])
    require_columns(anchors, ["item_id", "class", "anchor", "file", "low", "high"])
    s, a = sites.select("group_id", "site", "file", "line").distinct(), anchors.select("item_id", "class", "anchor", "file", "low", "high").distinct()
    touch = cut(s.join(a, "file").where("line BETWEEN low AND high").select("group_id", "site", "item_id", "class", "anchor").distinct())
    total = s.groupBy("group_id").agg(F.count_distinct("site").alias("total"))
    touched = touch.groupBy("group_id").agg(F.count_distinct("site").alias("touching"))
    live = a.groupBy("item_id").agg(F.count_distinct("anchor").alias("live"))
    per = touch.groupBy("group_id", "item_id", "class").agg(F.count_distinct("anchor").alias("covered"), F.count_distinct("site").alias("own"))
    all_ = per.join(total, "group_id").join(touched, "group_id").join(live, "item_id").withColumn("foreign", F.col("touching") - F.col("own"))
    return all_.select("group_id", "item_id", "class", "covered", "own", "foreign", "total", "live", credit(*map(F.col, ["covered", "own", "foreign", "total", "live"])).alias("credit"))


def score_summary(scored: DataFrame, items: DataFrame) -> DataFrame:
    """One row: n_items and credit of class A (best of each item), recall, true and false groups and precision among these.

    A group is true if it has credit for an A item, else false if it covers enough of a B item. Ratios of nothing are null.
    """
    best = scored.where("class = 'A'").groupBy("item_id").agg(F.max("credit").alias("credit")).agg(F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"))
    verdict = scored.groupBy("group_id").agg(
        F.max(F.when(F.col("class") == "A", F.col("credit") > 0)).alias("good"), F.max(F.when(F.col("class") == "B", F.col("covered") >= MIN_COVERED)).alias("bad"))
    good, bad = F.coalesce("good", F.lit(False)), F.coalesce("bad", F.lit(False))
    groups = verdict.agg(F.count_if(good).alias("n_true"), F.count_if(~good & bad).alias("n_false"))
    n = items.where("class = 'A'").agg(F.count_distinct("item_id").alias("n_items"))
    ratio = lambda x, of: F.when(of > 0, x / of)
    # Three single rows laid over one another.
    out = n.unionByName(best, allowMissingColumns=True).unionByName(groups, allowMissingColumns=True)
    out = out.agg(*[F.max(c).alias(c) for c in ("n_items", "credit", "n_true", "n_false")])
    return out.select("n_items", "credit", ratio(F.col("credit"), F.col("n_items")).alias("recall"), "n_true", "n_false", ratio(F.col("n_true"), F.col("n_true") + F.col("n_false")).alias("precision"))


def tree_fingerprints(nodes: DataFrame) -> DataFrame:
    """Merkle fingerprints of every subtree of ``nodes`` (id LONG, parent_id LONG, place, kind, label, is_name, is_value): id, fp1, fp2, fp3, mass, n_anchors.

    A node's digest is made of its kind, its label and the digests of its children with their places. fp1 keeps all labels, fp2 leaves out names that
    the unit gives itself (is_name), fp3 values (is_value) as well. mass: nodes of the subtree; n_anchors: labels in it that fp3 keeps.
    Children's digests are added up with their places mixed in, so a node with very many children needs no list of them. Levels are folded
    from the deepest upwards, one round each. Null flags are false, null labels empty. Nodes on or below loops are left out.
    """
    require_columns(nodes, ["id", "parent_id", "place", "kind", "label", "is_name", "is_value"])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = F.coalesce("label", F.lit(""))
    own = nodes.where("id IS NOT NULL").select(
        "id", "parent_id", "place", "kind", label.alias("l1"), F.when(flag("is_name"), "").otherwise(label).alias("l2"),
        F.when(flag("is_name") | flag("is_value"), "").otherwise(label).alias("l3"))
    depths = resolve_hierarchy(own).where("depth >= 0").select("id", "depth")
    rows = cut(own.join(depths, "id"))
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.sparkSession.createDataFrame([], "id long, fp1 string, fp2 string, fp3 string, mass long, n_anchors long")
    sums = ["s1", "s2", "s3", "below", "anchors_below"]
    below, levels = None, []
    for depth in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if below is None:
            level = level.select("*", *[F.lit(0).cast("decimal(38,0)" if c.startswith("s") else "long").alias(c) for c in sums])
        else:
            level = level.join(below, "id", "left").fillna(0, ["below", "anchors_below"]).withColumns({c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)") for c in sums[:3]})
        hashed = level.select(
            "id", "parent_id", "place", *[F.xxhash64("kind", f"l{k}", F.col(f"s{k}").cast("string")).alias(f"h{k}") for k in (1, 2, 3)],
            (F.col("below") + 1).alias("mass"), (F.col("anchors_below") + (F.col("l3") != "").cast("long")).alias("n_anchors"))
        done, _ = cut_counting(hashed, F.lit(True))
        levels.append(done)
        mixed = [F.sum(F.xxhash64("place", f"h{k}").cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"s{k}") for k in (1, 2, 3)]
        below = done.groupBy(F.col("parent_id").alias("id")).agg(*mixed, F.sum("mass").alias("below"), F.sum("n_anchors").alias("anchors_below"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("id", *[F.lower(F.lpad(F.hex(f"h{k}"), 16, "0")).alias(f"fp{k}") for k in (1, 2, 3)], "mass", "n_anchors")


def global_rank(rows: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """``rows`` with their place (from 1) by ``order`` within ``keys``, as ``out``; ``order`` should be total.

    Rows are dealt out by ranges and ranked within each; the ranges' sizes are then added up per key, so one hot key, or no key at all, is ranked
    by many tasks.
    """
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_p", before.alias("_before"))
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a._p") == F.col("b._p")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = local.alias("a").join(sizes.alias("b"), condition)
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("_r") + F.col("_before")).alias(out))
