"""Most similar vectors by an inverted file with an adaptive scan of dimensions.

Unit vectors are rotated by a random orthogonal matrix, so every block of columns carries a fair share of a distance. Within a
probed list candidates are compared block by block; a hypothesis test on the partial distance abandons those that are
surely farther than the k-th best found so far, and only survivors go on to the next block. How many lists are probed is
calibrated on a bounded sample of queries whose true neighbours are known from a pass over all rows.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import cut, require_columns

#: The lists are fitted on about this many vectors, or eight for each list where that is more, at most MAX_SAMPLE; all vectors are indexed.
SAMPLE = 20_000
MAX_SAMPLE = 200_000
#: Sampled queries whose true neighbours say how many lists must be probed, and the share of these neighbours to be found.
TRIALS = 512
RECALL = 0.99
#: Lists probed at least where a bound on the similarity is given.
PROBES = 6
#: Without a bound on the similarity, lists are searched only for neighbours this close if finding all would take more than a quarter of them.
TRUSTED = 0.8
#: Significance of the test; the larger, the fewer true neighbours are abandoned.
EPSILON = 2.1
BLOCK = 32
#: Components count as equal where they round to the same multiple of 1/GRID.
GRID = 1e5
#: Rows of a list compared in one task; larger lists are tiled, and every tile is compared.
TILE = 4096
#: Rows of either side of a tile of the exact comparison.
EXACT_TILE = 12_288
#: Pairs whose vectors are gathered at once.
_GATHER = 65_536
#: Queries compared at once, and the candidates that give them first bounds before the rest of a tile is scanned.
_ASK, _FIRST = 256, 512
_SLACK = 1e-5


def unit_vectors(table: DataFrame, dim: int) -> DataFrame:
    """Usable rows of ``table`` (id, vector): ``dim`` finite numbers, not all zero; each id once.

    Result: id, unit BINARY (float32) and direction, a digest that vectors of equal direction share (numbers equal to five decimals).

    A null id, null vector, null element, another size, NaN or infinity make a row unusable. Of an id with several usable vectors the
    smallest holds. Scaling first by the largest magnitude keeps tiny and huge vectors exact.
    """
    require_columns(table, ["id", "vector"])
    fine = (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = table.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    def scale(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["vector"].to_numpy())
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                grid = np.rint(x * GRID).astype(np.int32)
                keys = [blake2b(r.tobytes(), digest_size=16).digest() for r in grid]
                yield pd.DataFrame({"id": b["id"], "direction": keys, "unit": [r.tobytes() for r in x.astype(np.float32)]})

    scaled = rows.mapInPandas(scale, "id long, direction binary, unit binary")
    return scaled.groupBy("id").agg(F.min(F.struct("direction", "unit")).alias("v")).select("id", "v.*")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, dim)


def _kmeans(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids (unit length) by k-means on the sample, started from evenly spread rows."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:lists]]
    lists = len(c)
    for _ in range(8):
        home = (sample @ c.T).argmax(axis=1)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(lists))
        sums = np.add.reduceat(sample[order], np.minimum(starts, len(sample) - 1), axis=0)
        empty = np.bincount(home, minlength=lists) == 0
        sums[empty] = c[empty]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """About ``lists`` centroids; many of them are fitted in two levels, so the work grows with the square root of their number."""
    if lists <= 128:
        return _kmeans(sample, lists)
    coarse = _kmeans(sample, round(math.sqrt(lists)))
    home = (sample @ coarse.T).argmax(axis=1)
    parts = [sample[home == c] for c in range(len(coarse))]
    return np.concatenate([_kmeans(part, max(1, round(lists * len(part) / len(sample)))) for part in parts if len(part)])


def adaptive_scan(
    q: np.ndarray, x: np.ndarray, limit_q: np.ndarray, limit_x: np.ndarray, epsilon: float = EPSILON, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rows of q, rows of x, squared distance) within the limit of either row, rotated columns given.

    A pair goes on only while its partial distance over d of D columns is at most limit * d/D * (1 + epsilon/sqrt(d))^2, as a random
    rotation makes larger ones improbable for a true neighbour. While many pairs are left a block of columns is one matrix product;
    once they are few, only their columns are gathered, a bounded number of pairs at a time.
    """
    dim = q.shape[1]
    limit = np.maximum(limit_q[:, None], limit_x[None, :])
    share = lambda d: 1.0 if d >= dim else d / dim * (1 + epsilon / math.sqrt(d)) ** 2
    part, alive, start = np.zeros((len(q), len(x)), dtype=np.float32), None, 0
    while start < dim and (alive is None or alive.sum() * 8 > alive.size):
        qb, xb = q[:, start : start + block], x[:, start : start + block]
        part += (qb * qb).sum(1)[:, None] + (xb * xb).sum(1)[None, :] - 2 * (qb @ xb.T)
        start = min(start + block, dim)
        inside = part <= limit * share(start) + _SLACK
        alive = inside if alive is None else alive & inside
    a, b = np.nonzero(alive)
    sums, most = part[a, b], limit[a, b]
    while start < dim and len(a):
        for s in range(0, len(a), _GATHER):
            diff = q[a[s : s + _GATHER], start : start + block] - x[b[s : s + _GATHER], start : start + block]
            sums[s : s + _GATHER] += np.einsum("ij,ij->i", diff, diff)
        start = min(start + block, dim)
        keep = sums <= most * share(start) + _SLACK
        a, b, sums, most = a[keep], b[keep], sums[keep], most[keep]
    return a, b, sums


class _Best:
    """The ``k`` nearest partners of each of ``n`` rows so far; ties go to the smaller partner."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.dist = np.full((n, k), np.inf, dtype=np.float32)
        self.who = np.full((n, k), -1, dtype=np.int64)

    def add(self, rows: np.ndarray, partners: np.ndarray, dist: np.ndarray) -> None:
        better = dist <= self.dist[rows, -1]
        rows, partners, dist = rows[better], partners[better], dist[better]
        touched = np.unique(rows)
        a = np.concatenate([rows, np.repeat(touched, self.k)])
        d, w = np.concatenate([dist, self.dist[touched].ravel()]), np.concatenate([partners, self.who[touched].ravel()])
        order = np.lexsort((w, d, a))
        a, d, w = a[order], d[order], w[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        first = place < self.k
        self.dist[a[first], place[first]], self.who[a[first], place[first]] = d[first], w[first]


def nearest_in_tile(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int, radius2: float = math.inf) -> pd.DataFrame:
    """a (of qi), b (of xi), sim: the ``k`` nearest of every row of either side within the tile and ``radius2``, equal ids left out.

    At most k rows for each row of the tile come out, however dense it is; no set of all close pairs is ever held.
    """
    by_q, by_x = np.argsort(qi, kind="stable"), np.argsort(xi, kind="stable")
    qi, q, xi, x = qi[by_q], q[by_q], xi[by_x], x[by_x]
    best_q, best_x = _Best(len(q), k), _Best(len(x), k)
    for s in range(0, len(q), _ASK):
        for t, end in ((0, min(_FIRST, len(x))), (_FIRST, len(x))):
            if t >= end:
                continue
            own, other = slice(s, s + _ASK), slice(t, end)
            a, b, dist = adaptive_scan(q[own], x[other], np.minimum(best_q.dist[own, -1], radius2), np.minimum(best_x.dist[other, -1], radius2))
            fresh = qi[s + a] != xi[t + b]
            a, b, dist = a[fresh], b[fresh], dist[fresh]
            if len(a) > 4 * k * (_ASK + end - t):
                # Only the k nearest of a row or of a column can count.
                grid = np.full((len(q[own]), len(x[other])), np.inf, dtype=np.float32)
                grid[a, b] = dist
                rows = np.partition(grid, min(k, grid.shape[1]) - 1, axis=1)[:, min(k, grid.shape[1]) - 1]
                columns = np.partition(grid, min(k, grid.shape[0]) - 1, axis=0)[min(k, grid.shape[0]) - 1]
                near = (dist <= rows[a]) | (dist <= columns[b])
                a, b, dist = a[near], b[near], dist[near]
            best_q.add(s + a, t + b, dist)
            best_x.add(t + b, s + a, dist)
    a, i = np.nonzero(best_q.who >= 0)
    b, j = np.nonzero(best_x.who >= 0)
    pairs = np.unique(np.concatenate([np.stack([a, best_q.who[a, i]]), np.stack([best_x.who[b, j], b])], axis=1), axis=1)
    return pd.DataFrame({"a": qi[pairs[0]], "b": xi[pairs[1]], "sim": _cosines(q, pairs[0], x, pairs[1])})


def _cosines(q: np.ndarray, a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of row pairs in double precision, a bounded number at a time."""
    parts = [
        np.einsum("ij,ij->i", q[a[s : s + _GATHER]].astype(np.float64), x[b[s : s + _GATHER]].astype(np.float64)) for s in range(0, len(a), _GATHER)
    ]
    return np.round(np.concatenate([np.zeros(0), *parts]), 6)


def exact_nearest(asking: DataFrame, classes: DataFrame, k: int, dim: int) -> DataFrame:
    """The ``k`` most similar others among all ``classes`` of every row of ``asking`` (both class_id, unit), whatever their similarity.

    Every pair is compared, in tiles of at most about EXACT_TILE rows a side, so the work grows with the product of both sizes. Ties go
    to the smaller id. Result: a, b, sim.
    """
    parts = lambda n: max(1, math.ceil(n / EXACT_TILE))
    qs, xs = parts(asking.count()), parts(classes.count())

    def side(rows: DataFrame, asks: bool, own: int, across: int) -> DataFrame:
        mine, other = F.pmod(F.xxhash64("class_id"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(across - 1)))
        placed = rows.select("class_id", "unit", mine.cast("int").alias("own"), other.alias("other"))
        return placed.select("class_id", "unit", F.lit(asks).alias("asks"), F.col("own" if asks else "other").alias("qb"), F.col("other" if asks else "own").alias("xb"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        q, qi = _matrix(group["unit"][asks], dim), group["class_id"].to_numpy()[asks]
        xi = group["class_id"].to_numpy()[~asks]
        order = np.argsort(xi)
        xi, x = xi[order], _matrix(group["unit"][~asks], dim)[order]
        out = [pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})]
        for s in range(0, len(q) if len(x) else 0, 256):
            ids, some = qi[s : s + 256], q[s : s + 256]
            sim = some @ x.T
            at = np.minimum(np.searchsorted(xi, ids), len(xi) - 1)
            same = np.nonzero(xi[at] == ids)[0]
            sim[same, at[same]] = -3
            # A margin for single precision; what lies within it is compared again in double precision.
            floor = np.maximum(np.partition(sim, -k, axis=1)[:, -k] - 2e-6 if len(x) > k else -2, -2)
            a, b = np.nonzero(sim >= np.broadcast_to(floor, len(some))[:, None])
            exact = _cosines(some, a, x, b)
            best = np.lexsort((b, -exact, a))
            a, b, exact = a[best], b[best], exact[best]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append(pd.DataFrame({"a": ids[a[keep]], "b": xi[b[keep]], "sim": exact[keep]}))
        return pd.concat(out)

    tiles = side(asking, True, qs, xs).unionByName(side(classes, False, xs, qs))
    found = tiles.groupBy("qb", "xb").applyInPandas(compare, "a long, b long, sim double")
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


class _Index:
    """Fitted lists: centroids and rotation, shared with the executors."""

    def __init__(self, spark, units: np.ndarray, lists: int):
        dim = units.shape[1]
        turn = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, dim)))[0].astype(np.float32)
        centroids = _fit(units @ turn, lists)
        self.lists, self.dim = len(centroids), dim
        self.shared = spark.sparkContext.broadcast((centroids, turn))

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All lists of each rotated row, nearest first."""
        return np.argsort(-(x @ self.shared.value[0].T), axis=1, kind="stable")

    def near(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each rotated row, and its probed lists row by row; a bounded matrix at a time."""
        centroids, step = self.shared.value[0], max(1, 4_000_000 // self.lists)
        home, probed = [np.zeros(0, dtype=np.int64)], [np.zeros((0, probes), dtype=np.int64)]
        for s in range(0, len(x), step):
            sim = x[s : s + step] @ centroids.T
            home.append(sim.argmax(axis=1))
            probed.append(np.argpartition(-sim, probes - 1, axis=1)[:, :probes] if probes < self.lists else np.tile(np.arange(self.lists), (len(sim), 1)))
        return np.concatenate(home), np.concatenate(probed).ravel()


def _needed_probes(index: _Index, classes: DataFrame, trials: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, probes needed) of the true ``k`` nearest of the sampled queries ``trials``, found by one pass over all classes.

    A neighbour is found once its home list is among the query's probed lists, or the query's home among the neighbour's.
    """
    asked = index.shared.value[1]
    qi, q = np.array([r["class_id"] for r in trials]), _matrix([r["unit"] for r in trials], index.dim) @ asked
    known = classes.sparkSession.sparkContext.broadcast((qi, q))

    def run(batches):
        qi, q = known.value
        order = index.ranked(q)
        rank = np.argsort(order, axis=1)
        for b in batches:
            for s in range(0, len(b), 2048):
                part = b.iloc[s : s + 2048]
                xi, x = part["class_id"].to_numpy(), _matrix(part["unit"], index.dim) @ index.shared.value[1]
                sim = q @ x.T
                sim[qi[:, None] == xi[None, :]] = -3
                n = min(k, len(xi))
                best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                a, c = np.repeat(np.arange(len(qi)), n), best.ravel()
                ok = sim[a, c] > -2
                a, c = a[ok], c[ok]
                rows, at = np.unique(c, return_inverse=True)
                theirs = np.argsort(index.ranked(x[rows]), axis=1)
                home = theirs.argmin(axis=1)
                need = np.minimum(rank[a, home[at]], theirs[at, order[a, 0]]) + 1
                yield pd.DataFrame({"q": qi[a], "id": xi[c], "sim": sim[a, c].astype(np.float64), "need": need})

    found = classes.select("class_id", "unit").mapInPandas(run, "q long, id long, sim double, need long")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).where(F.col("r") <= k)
    rows = best.select("sim", "need").collect()  # at most k rows for each of TRIALS queries
    return np.array([r["sim"] for r in rows]), np.array([r["need"] for r in rows], dtype=np.int64)


def _probes(need: np.ndarray, recall: float) -> int:
    """Fewest probes that find the share ``recall`` of the neighbours."""
    return int(np.sort(need)[math.ceil(recall * len(need)) - 1]) if len(need) else 1


def _search_lists(index: _Index, classes: DataFrame, k: int, probes: int, least: float | None) -> DataFrame:
    """The ``k`` best found (a, b, sim) of every class, each compared in its ``probes`` nearest lists; a pair found from either side counts for both."""
    dim, lists, probes = index.dim, index.lists, min(probes, index.lists)

    def count(batches):
        total = np.zeros((2, lists), dtype=np.int64)
        for b in batches:
            if len(b):
                home, probed = index.near(_matrix(b["unit"], dim) @ index.shared.value[1], probes)
                total += np.stack([np.bincount(home, minlength=lists), np.bincount(probed, minlength=lists)])
        yield pd.DataFrame({"list": np.arange(lists), "n_rows": total[0], "n_asks": total[1]})

    def assign(batches):
        for b in batches:
            for s in range(0, len(b), step := max(1, 60_000 // probes)):
                part = b.iloc[s : s + step]
                x = _matrix(part["unit"], dim) @ index.shared.value[1]
                home, probed = index.near(x, probes)
                raw = np.array([r.tobytes() for r in x], dtype=object)
                ids = part["class_id"].to_numpy()
                yield pd.DataFrame({"list": home, "class_id": ids, "asks": False, "x": raw})
                yield pd.DataFrame({"list": probed, "class_id": np.repeat(ids, probes), "asks": True, "x": np.repeat(raw, probes)})

    # List sizes take a second, cheap assignment, so that the replicated vectors are shuffled once and stored nowhere.
    sizes = classes.select("unit").mapInPandas(count, "list int, n_rows long, n_asks long").groupBy("list").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_asks").alias("n_asks"))
    blocks = lambda c, size: F.greatest(F.lit(1).cast("long"), F.ceil(F.col(c) / size))
    sizes = sizes.select("list", blocks("n_rows", TILE).alias("xs"), blocks("n_asks", 2 * TILE).alias("qs"))
    placed = classes.select("class_id", "unit").mapInPandas(assign, "list int, class_id long, asks boolean, x binary")
    # At most `lists` rows, so a broadcast of bounded size. A tile is named by its list and its two block numbers.
    tiled = placed.join(F.broadcast(sizes), "list")
    across = F.when(F.col("asks"), F.col("xs")).otherwise(F.col("qs"))
    own = F.pmod(F.xxhash64("class_id"), F.when(F.col("asks"), F.col("qs")).otherwise(F.col("xs")))
    tiled = tiled.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), across - 1))})
    tiled = tiled.select(
        "list", "class_id", "asks", "x",
        F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("xb"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("qb"),
    )
    radius2 = math.inf if least is None else 2 - 2 * least + 1e-4

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        asks, ids = group["asks"].to_numpy(), group["class_id"].to_numpy()
        # Two more than k, as single precision may order near ties otherwise.
        out = nearest_in_tile(ids[asks], _matrix(group["x"][asks], dim), ids[~asks], _matrix(group["x"][~asks], dim), k + 2, radius2)
        return out if least is None else out[out["sim"] >= least]

    found = tiled.groupBy("list", "xb", "qb").applyInPandas(scan, "a long, b long, sim double")
    pairs = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def similar_vectors(table: DataFrame, k: int = 5, least: float | None = None, dim: int = 128, recall: float = RECALL, probes: int = PROBES) -> DataFrame:
    """For every usable vector of ``table`` (id, vector) its ``k`` most similar others, or those of cosine ``least`` or more among them.

    Vectors of equal direction form one class and are searched once: their members are each other's neighbours, the smallest ids
    first, so a group of copies of any size costs one row each. Ties of similarity go to the smaller id.

    The number of lists grows with the square root of the rows. So many lists of each vector are probed (with ``least``, ``probes`` at least) that
    the share ``recall`` of a sample's true neighbours is found. Without ``least``, if that would take more than a quarter of all lists (vectors
    without structure have no near lists), lists are searched for neighbours of cosine TRUSTED or more only, and vectors that have fewer than
    ``k`` of these are compared with all vectors in tiles by ``exact_nearest``. Either way each vector gets its whole ``k``.
    Every row is indexed. Unusable rows are left out, see ``unit_vectors``. Fewer than two usable vectors give no rows.
    Result: id, other_id, similarity, rank (from 1).
    """
    vectors = cut(unit_vectors(table, dim))
    spark = vectors.sparkSession
    schema = "id long, other_id long, similarity double, rank int"
    classes = cut(vectors.groupBy("direction").agg(F.min_by("unit", "id").alias("unit"), F.min("id").alias("class_id"), F.count("*").alias("n")))
    n = classes.count()
    if not n:
        return spark.createDataFrame([], schema)
    members = vectors.select("id", "direction").join(classes.select("direction", "class_id"), "direction").select("id", "class_id")
    want = round(math.sqrt(n) / 4)
    size = min(MAX_SAMPLE, max(SAMPLE, 8 * want))
    picked = classes.where(F.pmod(F.xxhash64("class_id"), F.lit(1_000_000_007)) < F.lit(max(1, math.ceil(min(1.0, size / n) * 1_000_000_007))))
    sample = sorted(picked.select("class_id", "unit").collect(), key=lambda r: r["class_id"])  # about `size` rows
    units = _matrix([r["unit"] for r in sample] or [r["unit"] for r in classes.limit(1).collect()], dim)
    index = _Index(spark, units, max(1, min(want, len(units) // 8)))
    trials = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
    sim, need = _needed_probes(index, classes, trials, k) if trials else (np.zeros(0), np.zeros(0, dtype=np.int64))
    close = max(probes, _probes(need[sim >= (TRUSTED if least is None else least)], recall))
    everything = _probes(need, recall)
    if least is not None:
        pairs = _search_lists(index, classes, k, close, least)
    else:
        whole = 4 * everything <= index.lists
        pairs = cut(_search_lists(index, classes, k, everything if whole else close, None if whole else TRUSTED))
        # A class of k near classes is served, and so is one of more than k members.
        have = pairs.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("near"))
        short = classes.join(have, "class_id", "left").where((F.coalesce("near", F.lit(0)) < k) & (F.col("n") <= k))
        short = cut(short.select("class_id", "unit"))
        served = pairs.join(short.select(F.col("class_id").alias("a")), "a", "left_anti")
        pairs = served.unionByName(exact_nearest(short, classes.select("class_id", "unit"), k, dim))
    # Of a class only its k + 1 smallest ids can be among anybody's k nearest. Ids ranked in salted parts first.
    salted = Window.partitionBy("class_id", "salt").orderBy("id")
    lowest = (
        members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        .withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
        .withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("id"))).where(F.col("r") <= k + 1)
        .select("class_id", F.col("id").alias("other_id"))
    )
    near = pairs.join(lowest.withColumnRenamed("class_id", "b"), "b").select(F.col("a").alias("class_id"), "other_id", "sim")
    inside = lowest.join(classes.where("n > 1").select("class_id"), "class_id").select("class_id", "other_id", F.lit(1.0).alias("sim"))
    best = Window.partitionBy("class_id").orderBy(F.desc("sim"), "other_id")
    # Up to k + 1 candidates per class: a member drops itself.
    short = near.unionByName(inside).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    short = short.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("r", "other_id", "sim"))).alias("near"))
    ranked = members.join(short, "class_id").select("id", F.posexplode(F.slice(F.filter("near", lambda e: e["other_id"] != F.col("id")), 1, k)).alias("i", "e"))
    return ranked.select("id", "e.other_id", F.col("e.sim").alias("similarity"), (F.col("i") + 1).alias("rank"))
