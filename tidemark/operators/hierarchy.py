"""Full hierarchies from parent-child links by pointer doubling.

Each unresolved node points at an ancestor; a round lets every such pointer jump to its target's own pointer, so
the jump doubles. Resolved nodes leave the loop; only the unresolved ones are joined again. What is unresolved after a
round that resolved nothing lies on a loop or below one. The driver keeps the plan of every round, so what fits in one
task is walked there at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut, cut_counting, require_columns

#: Up to so many links are walked in one task, in flat arrays of numbers; of more, rounds over all tasks resolve the rest first.
IN_ONE_TASK = 1_000_000


def _rings(up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that point at rows (-1: at none): the row reached beyond any tail, -1 where the walk ends; the rows on loops; the first row of each of their loops."""
    ptr, live = up.copy(), up >= 0
    left = np.count_nonzero(live)
    while left:
        ptr = np.where(live, ptr[ptr], -1)
        live, before = ptr >= 0, left
        left = np.count_nonzero(live)
        # A walk that ends later has an ancestor whose walk ended in this round.
        if left == before:
            break
    ring, low = np.unique(ptr[live]), np.arange(len(up))
    while len(np.unique(up[ring])) < len(ring):
        ptr[live] = ptr[ptr[live]]
        ring = np.unique(ptr[live])
    ahead, span = up.copy(), 1
    while span < len(ring):
        low[ring] = np.minimum(low[ring], low[ahead[ring]])
        ahead[ring] = ahead[ahead[ring]]
        span *= 2
    return ptr, ring, low


def _links(batches: Iterable[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
    """Rows (id, up, ...) by id, the ids, and where the row of each `up` is (-1: nowhere)."""
    found = list(batches)
    if not found:
        return None
    t = pa.Table.from_batches(found).sort_by("id")
    ids, up = t["id"].to_numpy(), t["up"]
    target = up.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(ids, target), max(len(ids) - 1, 0))
    return t, ids, np.where((ids[at] == target) & up.is_valid().to_numpy(), at, -1) if len(ids) else at


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, up, far), up never null: the first ancestor that is no row and how far it is, or the smallest id of the loop and whether the node is on it."""
    if (read := _links(batches)) is None:
        return
    t, ids, up = read
    over, ring, low = _rings(up)
    looped, on = over >= 0, np.zeros(len(ids), bool)
    on[ring] = True
    ptr, last, steps = np.where(looped, -1, up), np.arange(len(ids)), t["far"].fill_null(0).to_numpy().copy()
    unknown = t["far"].is_null().to_numpy().copy()
    while (live := ptr >= 0).any():
        to = ptr[live]
        steps[live] += steps[to]
        unknown[live] |= unknown[to]
        last[live], ptr[live] = last[to], ptr[to]
    yield from pa.table({
        "id": pa.array(ids), "up": pa.array(t["up"].to_numpy()[last], mask=looped), "steps": pa.array(steps, mask=looped | unknown),
        "root_id": pa.array(ids[low[over]], mask=~looped), "ring": pa.array(on),
    }).to_batches(max_chunksize=100_000)


def _count_below(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, up): ancestor_id and n_below."""
    if (read := _links(batches)) is None:
        return
    _, ids, up = read
    _, ring, low = _rings(up)
    n, ptr = np.ones(len(ids), np.int64), up.copy()
    ptr[ring] = -1
    while (live := ptr >= 0).any():
        more = n[live]
        np.add.at(n, ptr[live], more)
        ptr[live] = ptr[ptr[live]]
    # Whatever is below one node of a loop is below all of them.
    whole = np.zeros(len(ids), np.int64)
    np.add.at(whole, low[ring], n[ring])
    n[ring] = whole[low[ring]]
    yield from pa.table({"ancestor_id": pa.array(ids), "n_below": pa.array(n - 1)}).to_batches(max_chunksize=100_000)


def _lookup(pieces: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, pieces)


def resolve_hierarchy(nodes: DataFrame, with_paths: bool = False, weight: str | None = None) -> DataFrame:
    """Root and depth (and path) of every node of ``nodes`` (id LONG, parent_id LONG).

    One row per id is expected; exact repeats are dropped and of conflicting rows the smallest parent holds. A null id is no
    node. A parent that is null or names no node makes the node a root (depth 0, own root). A node on a loop or below
    one has depth -1, as root the smallest id on that loop, and a null path. A node that is its own parent is a loop.
    An empty table gives no rows; extra columns are ignored.
    With ``weight``, a LONG column of ``nodes`` that says how far a node lies from its parent, depth is the sum of these weights from the root.
    Result: id, root_id, depth LONG and, with paths, path ARRAY<LONG> from the root to the node. The size of all paths is
    the sum of depths, so ask for paths only where they are needed.
    """
    return _resolved(nodes, with_paths, weight).drop("ring")


def _resolved(nodes: DataFrame, with_paths: bool = False, weight: str | None = None) -> DataFrame:
    """As ``resolve_hierarchy``, with a column ring: whether the node is on a loop."""
    require_columns(nodes, ["id", "parent_id", *[weight] * bool(weight)])
    far = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    own = nodes.select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"), far.alias("far")).where("id IS NOT NULL")
    # Of equal parents the smallest weight holds.
    own = own.groupBy("id").agg(F.min("parent_id").alias("parent_id"), F.min_by("far", F.struct("parent_id", "far")).alias("far"))
    names = own.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    linked = own.join(names, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("up"), "far")
    # path: the ids after the ancestor `up`, down to the node itself. Without paths, the link itself stays at hand.
    kept = ["path"] if with_paths else ["parent_id", "far"]
    seg = [F.array("id").alias("path")] if with_paths else [F.col("up").alias("parent_id"), "far"]
    start, left = cut_counting(linked.select("id", "up", F.col("far").alias("steps"), *seg), F.col("up").isNotNull())
    paths = ["path"] if with_paths else []
    done = [start.where("up IS NULL").select("id", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), *paths)]
    open_ = start.where("up IS NOT NULL")
    while left:
        # Resolved targets first: they end the walk. Unresolved ones lend their pointer.
        ends = _lookup(done).select(F.col("id").alias("up"), "root_id", "depth", *[F.col("path").alias("head") for _ in paths])
        if not with_paths and left <= IN_ONE_TASK:
            links = open_.select("id", F.col("parent_id").alias("up"), "far").coalesce(1)
            walked = cut(links.mapInArrow(_walk, "id long, up long, steps long, root_id long, ring boolean"))
            done.append(walked.where("up IS NOT NULL").select("id", "up", "steps").join(ends, "up").select("id", "root_id", (F.col("depth") + F.col("steps")).alias("depth")))
            looped = walked.where("up IS NULL").select("id", "root_id", F.lit(-1).cast("long").alias("depth"), "ring")
            return _lookup(done).withColumn("ring", F.lit(False)).unionByName(looped)
        hops = open_.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), *[F.col("path").alias("mid") for _ in paths])
        both = ends.withColumns({"next": F.lit(None).cast("long"), "more": F.lit(None).cast("long"), **({"mid": F.lit(None).cast("array<long>")} if paths else {})}).unionByName(
            hops.withColumns({"root_id": F.lit(None).cast("long"), "depth": F.lit(None).cast("long"), **({"head": F.lit(None).cast("array<long>")} if paths else {})})
        )
        before = left
        moved, left = cut_counting(
            open_.join(both, "up").select(
                "id", "root_id", "next",
                (F.col("depth") + F.col("steps")).alias("depth"), (F.col("more") + F.col("steps")).alias("steps"),
                *([F.concat(F.coalesce("head", "mid"), "path").alias("path")] if paths else kept),
            ),
            F.col("root_id").isNull(),
        )
        open_ = moved.where("root_id IS NULL").select("id", F.col("next").alias("up"), "steps", *kept)
        # A round resolves the depths from its jump to just below twice that. A deeper node has an ancestor at the depth of the
        # jump, so where none was resolved only loops are left.
        if left == before:
            break
        done.append(moved.where("root_id IS NOT NULL").select("id", "root_id", "depth", *paths))
    resolved = _lookup(done).withColumn("ring", F.lit(False))
    if not left:
        return resolved
    return resolved.unionByName(_loops(open_, start).withColumns({p: F.lit(None).cast("array<long>") for p in paths}))


def _loops(open_: DataFrame, start: DataFrame) -> DataFrame:
    """Depth -1, the loop's smallest id and whether they are on it for nodes whose walks never end."""
    links = start.select("id", "up")
    while True:
        # Tails end within the doubled steps; once as many nodes are pointed at from the targets as there are, the targets are the loops.
        ring, size = cut_counting(open_.select(F.col("up").alias("id")).distinct().join(links, "id").select("id", "up", F.col("id").alias("low")), F.lit(True))
        if ring.select("up").distinct().count() == size:
            break
        hops = open_.select(F.col("id").alias("up"), F.col("up").alias("next"))
        open_ = cut(open_.select("id", "up").join(hops, "up").select("id", F.col("next").alias("up")))
    span, changed = 1, 1
    while span < size and changed:
        # Once windows of the doubled length found nothing smaller anywhere, every loop has seen its smallest id.
        ahead = ring.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("other"))
        moved = ring.join(ahead, "up").select("id", F.col("next").alias("up"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("less"))
        ring, changed = cut_counting(moved, F.col("less"))
        span *= 2
    low = ring.select(F.col("id").alias("up"), F.col("low").alias("root_id"))
    found = open_.select("id", "up").join(low, "up").select("id", "root_id", F.lit(-1).cast("long").alias("depth"))
    return found.join(ring.select("id", F.lit(True).alias("on")), "id", "left").select("id", "root_id", "depth", F.coalesce("on", F.lit(False)).alias("ring"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """Number of descendants, ancestor_id and n_below, of every node of ``nodes`` (id, parent_id), without its pairs.

    Links as in ``resolve_hierarchy``. A node on a loop has all other nodes on and below the loop as descendants. Sums travel up jumps
    that double: a node hands what it has counted so far to the ancestor just beyond.
    """
    require_columns(nodes, ["id", "parent_id"])
    own = nodes.select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id")).where("id IS NOT NULL")
    own, size = cut_counting(own.groupBy("id").agg(F.min("parent_id").alias("parent_id")), F.lit(True))
    if size <= IN_ONE_TASK:
        return own.select("id", F.col("parent_id").alias("up")).coalesce(1).mapInArrow(_count_below, "ancestor_id long, n_below long")
    ring = cut(_resolved(own).where("ring").select("id", "root_id"))
    known = own.select(F.col("id").alias("up"))
    open_ = own.select("id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("n")).join(known, "up", "left_semi").join(ring, "id", "left_anti")
    open_, left = cut_counting(open_.select("id", "up", "n"), F.lit(True))
    none = F.lit(0).cast("long")
    got = []
    while left:
        handed = open_.select("id", "up", "n", none.alias("more")).unionByName(open_.select(F.col("up").alias("id"), F.lit(None).cast("long").alias("up"), "n", F.col("n").alias("more")))
        sums = cut(handed.groupBy("id").agg(F.max("up").alias("up"), F.sum("n").alias("n"), F.sum("more").alias("more")))
        got.append(sums.where("more > 0").select("id", "more"))
        still = sums.where("up IS NOT NULL")
        open_, left = cut_counting(still.select("id", "up", "n").join(still.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up"), "n"), F.lit(True))
    parts = [own.select("id", none.alias("more")), *got]
    below = _lookup(parts).groupBy("id").agg(F.sum("more").alias("n")).join(ring, "id", "left")
    whole = below.where("root_id IS NOT NULL").groupBy("root_id").agg((F.sum(F.col("n") + 1) - 1).alias("whole"))
    return below.join(whole, "root_id", "left").select(F.col("id").alias("ancestor_id"), F.coalesce("whole", "n").alias("n_below"))


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor_id, id, distance) pairs of a hierarchy with paths, each node with itself at distance 0; loops have none."""
    walked = resolved.where("path IS NOT NULL").select("id", F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor_id"))
    return walked.select("ancestor_id", "id", (F.col("n") - 1 - F.col("pos")).cast("long").alias("distance"))


def all_descendants(nodes: DataFrame) -> DataFrame:
    """All (ancestor_id, id, distance) pairs of ``nodes`` (id, parent_id), each node with itself at distance 0, loops included.

    On or below a loop the ancestors of a node are its path from the loop's entry node down and every node of that loop, each once, at
    the distance at which the walk upwards first meets it.
    """
    require_columns(nodes, ["id", "parent_id"])
    own = nodes.select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id")).where("id IS NOT NULL")
    own = own.groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    resolved = cut(resolve_hierarchy(own, with_paths=True))
    stuck = cut(resolved.where("depth = -1").select("id", F.col("root_id").alias("low")).join(own, "id"))
    # Without the link of its smallest node a loop is a tree below that node, and that node's parent is its far end. Pointers double
    # over all of these few nodes, with a small plan in each round.
    up = F.when(F.col("id") != F.col("low"), F.col("parent_id"))
    opened = cut(stuck.select("id", F.col("low").alias("root_id"), up.alias("up"), F.array("id").alias("path")))
    left = 1
    while left:
        hops = opened.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        path = F.concat(F.coalesce("head", F.array().cast("array<long>")), "path")
        opened, left = cut_counting(opened.join(hops, "up", "left").select("id", "root_id", F.col("next").alias("up"), path.alias("path")), F.col("up").isNotNull())
    rings = stuck.where("id = low").select("low", F.col("parent_id").alias("id")).join(opened.select("id", "path"), "id").select(F.col("low").alias("root_id"), F.col("path").alias("ring"))
    # What of the loop is not on the path lies behind its smallest node, the far end first.
    around = opened.join(rings, "root_id").select("id", F.size("path").alias("n"), F.posexplode(F.reverse(F.array_except("ring", "path"))).alias("pos", "ancestor_id"))
    around = around.select("ancestor_id", "id", (F.col("n") + F.col("pos")).cast("long").alias("distance"))
    return descendants(resolved).unionByName(descendants(opened)).unionByName(around)
