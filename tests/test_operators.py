from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import graph as G
from tidemark.operators import scores as S
from tidemark.operators import search, windows
from tidemark.operators.blocks import block_search
from tidemark.operators.joins import as_of, next_event, overlapping, point_in_interval
from tidemark.operators.similarity import set_similarity, templates


def test_merge_intervals(spark):
    spans = [("a", 0, 5), ("a", 5, 9), ("a", 11, 12), ("a", 1, 2), ("a", 11, 12), ("b", 3, None), ("b", None, 4), ("b", 1, 1)]
    got = windows.merge_intervals(spark.createDataFrame(spans, "k string, s long, e long"), ["k"], "s", "e")
    assert rows(got) == [("a", 0, 9, 3), ("a", 11, 12, 2), ("b", 1, 1, 1)]


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_two_level_operators_against_loops(spark, bucket):
    rng = random.Random(bucket)
    spans = [(rng.choice("ab"), s, s + rng.randrange(0, 9)) for s in rng.choices(range(-40, 200), k=50)] + [(None, 1, 2), ("a", None, 2)]
    got = rows(windows.merge_intervals(spark.createDataFrame(spans, "k string, s long, e long"), ["k"], "s", "e", bucket).select("k", "s", "e"))
    want = []
    for k in "ab":
        cur = None
        for _, s, e in sorted(x for x in spans if x[0] == k and x[1] is not None):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                want.append((k, cur))
    assert got == sorted([(k, s, e) for k, (s, e) in want], key=repr)
    ev = [(rng.choice("ab"), rng.randrange(-30, 90), i, rng.choice(["x", None, "z"])) for i in range(40)]
    pr = [(rng.choice("abc"), rng.randrange(-40, 100), i) for i in range(40)] + [(None, 5, 98), ("a", None, 99)]
    e, p = spark.createDataFrame(ev, "k string, t long, o long, who string"), spark.createDataFrame(pr, "k string, t long, pid long")

    def last(k, t):
        ok = [x for x in ev if k is not None and t is not None and x[0] == k and x[1] <= t]
        return max(ok, key=lambda x: (x[1], x[2]))[3] if ok else None

    def following(k, t):
        return min((x[1] for x in ev if k is not None and t is not None and x[0] == k and x[1] >= t), default=None)

    assert rows(as_of(p, e, "k", "t", "o", ["who"], bucket).select("pid", "who")) == sorted([(i, last(k, t)) for k, t, i in pr], key=repr)
    assert rows(next_event(p, e, ["k"], "t", "n", bucket).select("pid", "n")) == sorted([(i, following(k, t)) for k, t, i in pr], key=repr)


def test_gap_is_strict(spark):
    ev = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 119_999, 239_999, 360_000])], "k string, t long, i long")
    assert [r["session_no"] for r in windows.gap_sessions(ev, ["k"], "t", "i", 120_000).orderBy("i").collect()] == [0, 0, 1, 2]


def test_k_windows_and_islands(spark):
    r = spark.createDataFrame([("a", i, v) for i, v in [(1, "x"), (2, "y"), (3, "x"), (5, "z")]], "k string, o int, v string")
    assert rows(windows.k_windows(r, ["k"], "o", "v", 2, 3)) == [("a", 1, 2, "x,y"), ("a", 1, 3, "x,y,x"), ("a", 2, 2, "y,x")]


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "k string, rank int")
    b = spark.createDataFrame([("y", 1)], "k string, rank int")
    got = {r["k"]: r["score"] for r in windows.reciprocal_rank_fusion([a, b], "k").collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61})


def test_interval_joins_against_loops(spark):
    rng = random.Random(1)
    spans = [(rng.choice("ab"), i, s, s + rng.randrange(0, 40)) for i, s in enumerate(rng.sample(range(200), 40))] + [("a", 99, 10, 5), (None, 98, 0, 9)]
    points = [(rng.choice("ab"), i, rng.randrange(0, 220)) for i in range(60)]
    sp = spark.createDataFrame(spans, "k string, sid long, s long, e long")
    pt = spark.createDataFrame(points, "k string, pid long, t long")
    got = rows(point_in_interval(pt, sp, "k", "t", "s", "e", 16).select("pid", "sid"))
    assert got == sorted([(p, i) for pk, p, t in points for k, i, s, e in spans if k == pk and s <= t <= e], key=repr)
    right = sp.select("k", F.col("sid").alias("rid"), F.col("s").alias("c"), F.col("e").alias("d"))
    got = rows(overlapping(sp, right, "k", ("s", "e"), ("c", "d"), 16).select("sid", "rid"))
    ok = [x for x in spans if x[0] and x[2] <= x[3]]
    assert got == sorted([(a[1], b[1]) for a in ok for b in ok if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3]], key=repr)


def test_as_of_and_next(spark):
    ev = spark.createDataFrame([("f", 10, 1, "a"), ("f", 10, 2, "b"), ("f", 20, 3, None), ("g", 1, 4, "z")], "k string, t long, o long, who string")
    pr = spark.createDataFrame([("f", 9, 1), ("f", 10, 2), ("f", 25, 3), ("h", 5, 4), ("g", 1, 5)], "k string, t long, pid long")
    assert rows(as_of(pr, ev, "k", "t", "o", ["who"]).select("pid", "who")) == [(1, None), (2, "b"), (3, None), (4, None), (5, "z")]
    assert rows(next_event(pr, ev, ["k"], "t", "n").select("pid", "n")) == [(1, 10), (2, 10), (3, None), (4, None), (5, 1)]


def test_reach_chains_and_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (6, 7), (7, 6), (None, 1), (8, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (6,), (None,)], "seed long")
    r = G.reach(e, seeds)
    assert sorted((x["seed"], x["node"], x["depth"]) for x in r.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 5, 3), (6, 6, 0), (6, 7, 1)]
    chain = {x["node"]: x["chain"] for x in G.chains(r, 3).where("seed = 1").collect()}
    assert chain[5] == [1, 2, 3, 5]
    assert len(G.reach(e, seeds, 1).collect()) == 5
    assert rows(G.components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6), (8, 8)]


def test_components_of_a_long_chain(spark):
    e = spark.range(1, 120).selectExpr("id AS src", "id + 1 AS dst")
    assert {r["component"] for r in G.components(e).collect()} == {1}


def test_path_tree_and_lanes(spark):
    t = G.path_tree(spark.createDataFrame([("a/b/c.js",), ("a/d.js",), ("e.js",)], "path string"), "path")
    assert rows(t) == [("a", 2, 1), ("a/b", 1, 2)]
    assert G.plan_lanes({1: 5, 2: 4, 3: 3, 4: 3}, 2) == [[1, 4], [2, 3]]


def test_set_similarity_against_all_pairs(spark):
    rng = random.Random(2)
    sets = [(i, rng.sample("abcdefghij", rng.randrange(1, 9))) for i in range(60)] + [(100, []), (101, None), (102, ["a", "a", "b"]), (103, ["b", "a"])]
    members, links = set_similarity(spark.createDataFrame(sets, "id long, items array<string>"), 0.6)
    cls = dict(tuple(r) for r in members.collect())
    assert cls[102] == cls[103] and len(cls) == len(sets)
    byc = {cls[i]: set(s or []) for i, s in sets}
    want = {(a, b) for a in byc for b in byc if a < b and byc[a] and byc[b] and len(byc[a] & byc[b]) / len(byc[a] | byc[b]) >= 0.6 - 1e-12}
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == want


def test_templates(spark):
    t = templates(spark.createDataFrame([("g", ["a", "b", "c"]), ("g", ["a", "x", "c"]), ("g", ["a"]), ("h", None)], "g string, t array<string>"), "g", "t")
    assert rows(t) == [("g", 1, "a", 1, 0), ("g", 3, "a ? c", 2, 1)]


def test_block_search_in_several_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [1.0])], "id long, vector array<double>")
    got = {(r["query_id"], r["id"]) for r in block_search(df, df.where("id % 5 = 0"), 0.3, block_rows=3).collect()}
    s = x @ x.T
    assert got == {(q, i) for q in range(0, 50, 5) for i in range(50) if q != i and s[q, i] >= 0.3}
    assert block_search(df, df.limit(0), 0.3).collect() == []


def test_bm25_prefers_rare_and_short(spark):
    docs = spark.createDataFrame([(1, ["cat", "dog"]), (2, ["cat"] * 3 + ["x"] * 20), (3, ["dog"]), (4, ["fish"])], "d long, w array<string>")
    got = {r["d"]: r["score"] for r in search.bm25(search.postings(docs, "d", F.col("w")), "d", ["fish", "ca"], prefix=True).collect()}
    assert set(got) == {1, 2, 4} and got[4] > got[1]


def test_scores(spark):
    v = spark.createDataFrame([("g", "CRITICAL"), ("g", "LOW"), ("g", None)], "g string, severity string")
    f = spark.createDataFrame([("g",), ("g",), ("h",)], "g string")
    got = {r["g"]: (r["score"], r["grade"]) for r in S.health(v, f, ["g"]).collect()}
    assert got == {"g": (93, "A"), "h": (100, "A+")}  # 100 - 1.5 * 10 / 2 = 92.5, rounded half up


def test_accounting_ceil_of_sum(spark):
    c = spark.createDataFrame([("a", 1, "file-whole", 3, 0), ("a", 1, "file-whole", 3, 0), ("a", 2, None, None, None), ("a", 5, "validation-call", 0, 2)],
                              "verb string, result_chars long, cf_kind string, cf_chars long, cf_calls long")
    r = S.account_calls(c, ["verb"]).first()
    assert (r["n_calls"], r["n_measured"], r["overhead_tokens"], r["gross_saved"], r["unmeasured_tokens"], r["net_saved"], r["avoided"], r["is_thin"]) == (4, 2, 3, 1, 2, -1, 2, True)


@pytest.mark.parametrize("limit,most", [(0, 24), (20, 24), (10**6, 1)])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, limit, most):
    cuts, pick = [], random.Random(3)
    monkeypatch.setattr(G, "IN_ONE_TASK", limit)
    for name in ("cut", "cut_counting"):
        monkeypatch.setattr(G, name, lambda *a, f=getattr(G, name): cuts.append(1) or f(*a))
    # A chain, a star around its largest node, a sparse tangle, a node by itself, pairs, repeats and null ends.
    pairs = [(i, i + 1) for i in range(100, 160)] + [(999, 500 + i) for i in range(40)] + [(pick.randrange(1000, 1080), pick.randrange(1000, 1080)) for _ in range(60)]
    pairs += [(7, 7), (8, 9), (9, 8), (8, 9), (10, 10), (10, 11)]
    want: dict = {}
    for a, b in pairs:
        joined = want.get(a, {a}) | want.get(b, {b})
        want |= dict.fromkeys(joined, joined)
    got = G.components(spark.createDataFrame(pairs + [(None, 1), (2, None)], "src long, dst long"))
    assert rows(got) == sorted([(i, min(s)) for i, s in want.items()], key=repr) and len(cuts) <= most
    named = spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "x")], "src string, dst string")
    assert rows(G.components(named)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")]
    assert G.components(named.limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_set_similarity_against_all_pairs(spark, threshold):
    pick = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    base = [pick.sample(words, n) for n in (1, 2, 5, 8, 10, 12, 17, 20, 25, 30, 45)]
    sets = {}
    for b in base * 9:
        s = set(b)
        for _ in range(pick.randrange(4)):
            s ^= {pick.choice(words)}
        sets[len(sets)] = s
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    c = sorted((i, s) for s, i in first.items() if s)
    want = {(i, j) for i, a in c for j, b in c if i < j and len(a & b) >= threshold * len(a | b) - 1e-9}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<string>")
    _, links = set_similarity(df, threshold)
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == want and want


def test_set_similarity_writes_no_pairs_but_links(spark):
    # Any two sets of a tenth share their two rarest items, and hardly a pair is similar. No exchange lies above the join of the keys.
    sets = [(i, [f"r{i % 10}", f"q{i % 10}"] + [f"c{j}" for j in pick.sample(range(40), 8)]) for pick in [random.Random(7)] for i in range(600)]
    _, links = set_similarity(spark.createDataFrame(sets, "id long, items array<string>"), 0.8)
    plan = links._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    got = [(r["class_a"], r["class_b"]) for r in links.collect()]
    assert len(got) == len(set(got))
