"""Reachability, components and path trees on edge frames; every hop cuts its lineage by a reliable checkpoint."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut, cut_counting

#: Up to so many links are joined in one task, in flat arrays; more are contracted by rounds over all tasks first.
IN_ONE_TASK = 1_000_000


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from each seed along ``edges`` (src, dst), breadth first.

    ``seeds`` has seed. Result: seed, node, depth (shortest), parent (the smallest predecessor at that depth); the seed itself has depth 0
    and no parent. Each hop joins only the frontier, drops what was visited and is checkpointed. Without ``max_depth`` the
    walk ends when nothing new is found. Loops are fine. Null ends are ignored.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    start = cut(seeds.where("seed IS NOT NULL").select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["seed"].dataType).alias("parent")))
    levels, frontier, depth = [start], start, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("seed", F.col("node").alias("src")).join(e, "src").groupBy("seed", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        seen = reduce(DataFrame.unionByName, levels).select("seed", "node")
        frontier = cut(step.join(seen, ["seed", "node"], "left_anti").select("seed", "node", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def chains(reached: DataFrame, max_depth: int) -> DataFrame:
    """Path from the seed to every node of a ``reach`` result, following parents level by level: seed, node, depth, chain."""
    out = [reached.where("depth = 0").select("seed", "node", "depth", F.array("node").alias("chain"))]
    for k in range(1, max_depth + 1):
        above = out[-1].select("seed", F.col("node").alias("parent"), F.col("chain").alias("head"))
        level = reached.where(F.col("depth") == k).join(above, ["seed", "parent"])
        out.append(level.select("seed", "node", "depth", F.concat("head", F.array("node")).alias("chain")))
    return reduce(DataFrame.unionByName, out)


def _join_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (src, dst): node and the smallest node of its component."""
    found = list(batches)
    if not found:
        return
    t = pa.Table.from_batches(found)
    names, ends = np.unique(np.concatenate([t["src"].to_numpy(), t["dst"].to_numpy()]), return_inverse=True)
    a, b, top = ends[: len(t)], ends[len(t) :], np.arange(len(names))
    while len(a):
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top != (up := top[top])).any():
            top = up
        a, b = top[a], top[b]
        a, b = a[differ := a != b], b[differ]
    kind = t.schema.field("src").type
    yield from pa.table({"node": pa.array(names, kind), "component": pa.array(names[top], kind)}).to_batches(max_chunksize=100_000)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst): node, component (smallest node id in it).

    Every node hooks on to its smallest neighbour where that is smaller, pointers jump to the end, and each tree becomes one node. Two such
    rounds halve the nodes at least. Links that fit in one task are joined there. Only minima are aggregated, never neighbour lists. Null
    ends are ignored.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    pairs, n = cut_counting(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), F.lit(True))
    kind = pairs.schema["src"].dataType.simpleString()
    left, trees = pairs, []
    while n > IN_ONE_TASK:
        both = left.union(left.select("dst", "src"))
        tree = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("to")))
        moved = 1
        while moved:
            hop = tree.select(F.col("node").alias("to"), F.col("to").alias("next"))
            tree, moved = cut_counting(tree.join(hop, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), F.col("moved"))
        trees.append(tree)
        low, high = tree.select(F.col("node").alias("src"), F.col("to").alias("a")), tree.select(F.col("node").alias("dst"), F.col("to").alias("b"))
        joined = left.join(low, "src").join(high, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        left, n = cut_counting(joined.distinct(), F.lit(True))
    out = left.coalesce(1).mapInArrow(_join_up, f"node {kind}, component {kind}")
    for tree in reversed(trees):
        out = tree.join(out.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return out


def path_tree(paths: DataFrame, column: str) -> DataFrame:
    """Folders of slash-separated paths: folder, depth, n_files (all files below), every prefix once."""
    parts = F.split(column, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = paths.where(F.size(parts) > 1).select(F.explode(prefixes).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n_files")).withColumn("depth", F.size(F.split("folder", "/")))


def plan_lanes(weights: dict[int, int], lanes: int) -> list[list[int]]:
    """Heaviest group to the lightest lane. Sequential by definition, so for the bounded page of groups a planner looks at."""
    out: list[list[int]] = [[] for _ in range(lanes)]
    load = [0] * lanes
    for key in sorted(weights, key=lambda k: (-weights[k], k)):
        i = min(range(lanes), key=lambda n: (load[n], n))
        out[i].append(key)
        load[i] += weights[key]
    return out
