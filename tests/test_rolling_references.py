from __future__ import annotations

import random

from tidemark.operators.references import broken_references, reference_report
from tidemark.operators.rolling import trailing_totals


def test_trailing_totals_against_loop(spark):
    rng = random.Random(5)
    facts = [(e, rng.randrange(0, 90), rng.choice([None, 1, 5, 9])) for e in "ab" for _ in range(25)] + [(None, 3, 4), ("a", None, 7)]
    df = spark.createDataFrame([(*f, "x") for f in facts], "entity string, day int, m long, active string")
    got = {(r["entity"], r["day"]): r for r in trailing_totals(df, ["m"]).collect()}
    for e in "ab":
        days = [d for x, d, _ in facts if x == e and d is not None]
        for day in range(min(days), max(days) + 1):
            r = got.pop((e, day))
            for n in (7, 30):
                want = sum(m or 0 for x, d, m in facts if x == e and d is not None and day - n < d <= day)
                assert r[f"m_sum_{n}d"] == want and abs(r[f"m_avg_{n}d"] - want / n) < 1e-9
            assert r["active"] == (day in days) and r["day_index"] == day - min(days) + 1
    assert not got


def test_trailing_totals_empty(spark):
    assert trailing_totals(spark.createDataFrame([], "entity string, day int, m long"), ["m"]).collect() == []


def test_broken_references(spark):
    children = spark.createDataFrame(
        [("1", "a", "p", 5, "z"), ("2", "x", "p", 5, "z"), ("3", None, "p", 5, "z"), ("4", "d", "q", None, "z"), ("5", "a", "q", 50, "z"), ("6", "n", "q", 1, "z"), ("7", "a", "q", None, "z")],
        "row_key string, ref string, period string, at long, deleted string")
    parents = spark.createDataFrame([("a", False, 10), ("d", True, 1), ("n", None, None), (None, False, 1), ("a", True, 20)], "ref string, deleted boolean, created_at long")
    found = broken_references(children, parents)
    assert sorted((r["row_key"], r["kind"]) for r in found.collect()) == [("1", "late"), ("2", "missing"), ("4", "deleted")]
    assert sorted(tuple(r) for r in reference_report(found, ["period", "kind"]).collect()) == [("p", "late", 1, 1), ("p", "missing", 1, 1), ("q", "deleted", 1, 1)]


def test_references_without_parents_or_children(spark):
    children = spark.createDataFrame([("1", "a", "p")], "row_key string, ref string, period string")
    none = spark.createDataFrame([], "ref string, deleted boolean")
    assert [r["kind"] for r in broken_references(children, none).collect()] == ["missing"]
    assert broken_references(children.limit(0), none).collect() == []


def test_hot_orphan_key_keeps_every_row(spark):
    children = spark.range(3000).selectExpr("CAST(id AS STRING) AS row_key", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS ref", "'p' AS period")
    parents = spark.range(3000).selectExpr("CAST(id AS STRING) AS ref", "false AS deleted")
    assert broken_references(children, parents).count() == 1000
