"""Judging of groups, fingerprints of trees, ranks over all rows, index records and duplicate links, on fixtures."""

from __future__ import annotations

import random

import pytest

from tests.conftest import rows
from tidemark.operators.evidence import credit, global_rank, score_groups, score_summary, tree_fingerprints
from tidemark.plans.ledger import duplicate_links, resolve_since
from tidemark.sources.scan import ROOT_ONLY_DIRS, index_records, is_ignored
from pyspark.sql import functions as F

NODES = "id long, parent_id long, place long, kind string, label string, is_name boolean, is_value boolean, fp1 string"


def prints(spark, nodes):
    return {r["id"]: r for r in tree_fingerprints(spark.createDataFrame([(*n, "clash") for n in nodes], NODES)).collect()}


def tree(base, name="x", value="1", call="read", flip=False):
    a, b = (2, 1) if flip else (1, 2)
    return [
        (base, None, 0, "fn", "", False, False), (base + 1, base, a, "decl", name, True, False), (base + 2, base, b, "call", call, False, False),
        (base + 3, base + 2, 1, "literal", value, False, True),
    ]


def test_levels_of_fingerprints(spark):
    got = prints(spark, tree(10) + tree(20) + tree(30, name="y") + tree(40, value="2") + tree(50, call="write") + tree(60, flip=True))
    a, same, named, valued, other, flipped = (got[i] for i in range(10, 70, 10))
    fp = lambda r: (r["fp1"], r["fp2"], r["fp3"])
    assert fp(a) == fp(same) and a["mass"] == 4 and a["n_anchors"] == 1 and got[12]["mass"] == 2
    assert a["fp1"] != named["fp1"] and (a["fp2"], a["fp3"]) == (named["fp2"], named["fp3"])
    assert a["fp2"] != valued["fp2"] and a["fp3"] == valued["fp3"]
    assert a["fp3"] != other["fp3"] and a["fp3"] != flipped["fp3"]


def test_loops_nulls_and_no_tree(spark):
    assert prints(spark, []) == {}
    got = prints(spark, [(1, 2, 0, "a", "", False, False), (2, 1, 0, "a", "", False, False), (3, None, 0, "a", None, None, None), (None, 3, 0, "a", "", False, False)])
    assert list(got) == [3] and got[3]["mass"] == 1


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rank_over_all_rows(spark, keys):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, v int, id long")
    got = {r["id"]: r["place"] for r in global_rank(df, keys, [F.desc("v"), F.col("id")], "place").collect()}
    want, seen = {}, {}
    for k, v, i in sorted(data, key=lambda r: (-r[1], r[2])):
        group = k if keys else 0
        seen[group] = seen.get(group, 0) + 1
        want[i] = seen[group]
    assert got == want
    assert global_rank(df.limit(0), keys, [F.col("id")], "place").collect() == []


@pytest.mark.parametrize("covered, own, foreign, total, live, want", [
    (2, 2, 0, 2, 4, 1.0), (2, 2, 0, 2, 5, 0.5), (2, 2, 1, 3, 2, 0.5), (1, 2, 0, 2, 1, 0.0), (2, 1, 0, 5, 2, 0.0), (2, 2, 3, 5, 2, 0.0), (2, 0, 0, 0, 2, 0.0)])
def test_credit(spark, covered, own, foreign, total, live, want):
    assert spark.range(1).select(credit(*map(F.lit, (covered, own, foreign, total, live)))).first()[0] == want


def test_scores(spark):
    sites = [("g", 1, "f", 5), ("g", 2, "f", 15), ("g", 2, "f", 15), ("h", 3, "f", 105), ("h", 4, "f", 115), ("i", 5, "none", 1), ("i", 6, None, None)]
    anchors = [("A1", "A", 1, "f", 1, 9), ("A1", "A", 2, "f", 10, 19), ("B1", "B", 3, "f", 100, 109), ("B1", "B", 4, "f", 110, 119), ("A2", "A", 5, "z", 1, 2)]
    s = spark.createDataFrame(sites, "group_id string, site long, file string, line int")
    a = spark.createDataFrame(anchors, "item_id string, class string, anchor long, file string, low int, high int")
    scored = score_groups(s, a)
    assert rows(scored.select("group_id", "item_id", "covered", "own", "foreign", "credit")) == [("g", "A1", 2, 2, 0, 1.0), ("h", "B1", 2, 2, 0, 1.0)]
    assert tuple(score_summary(scored, a).first()) == (2, 1.0, 0.5, 1, 1, 0.5)
    assert tuple(score_summary(scored.limit(0), a.limit(0)).first()) == (0, 0.0, None, 0, 0, None)


def test_index_records(spark):
    text = 'import { a } from "./a.js";\nfrom os import path\nexport function run() { useState(1); }\nconst ä = 1\nconst run = 2\nuseState()'
    df = spark.createDataFrame([("x", text, "c"), ("y", "", "c"), ("z", None, "c")], "path string, text string, size string")
    got = {r["path"]: r for r in index_records(df).collect()}
    assert sorted(got) == ["x", "y"] and got["y"]["lines"] == 0 and got["y"]["symbols"] == []
    x = got["x"]
    assert (x["size"], x["chars"], x["lines"]) == (len(text.encode()), len(text), 5)
    assert (x["symbols"], x["imports"], x["hooks"]) == (["run"], ["./a.js", "os"], ["useState"])


def test_folders_left_out(spark):
    paths = ["build/a.js", "src/build/a.js", "src/vendor/a.js", "out/x", "a/out/x", "ok.js", "src/.next/y"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r[0] for r in df.where(~is_ignored(F.col("path"))).collect()) == ["a/out/x", "ok.js", "src/build/a.js"]
    assert "build" in ROOT_ONLY_DIRS


def test_duplicate_links(spark):
    e = [(1, 1, '{"duplicate_of":9}'), (1, 2, '{"duplicate_of":2}'), (1, 3, "{torn"), (2, 1, '{"duplicate_of":3}'), (4, 1, '{"duplicate_of":5}'), (5, 1, '{"duplicate_of":4}'), (6, 1, None), (7, 1, '{"duplicate_of":null}')]
    got = duplicate_links(spark.createDataFrame(e, "task_id long, seq int, metadata string"))
    assert rows(got) == [(1, 3, 2), (2, 3, 1)]


def test_since(spark):
    now = F.lit(3 * 86_400_000 + 5).cast("long")
    assert [spark.range(1).select(resolve_since(x, now)).first()[0] for x in ("1000", "", None, "soon", "-4")] == [1000, *[3 * 86_400_000] * 4]
