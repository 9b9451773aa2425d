from __future__ import annotations

import random

import pytest

from tidemark.operators.selection import first_disjoint, heaviest_disjoint

SCHEMA = "grp string, sid long, a long, b long, w long, g string"


def spans(seed, n=70):
    rng = random.Random(seed)
    out = [(rng.choice("xy"), i, s, s + rng.randrange(1, 12), rng.randrange(4), "clash") for i, s in enumerate(rng.choices(range(60), k=n))]
    return out + [("x", 900, 5, 5, 1, ""), ("x", 901, None, 5, 1, ""), (None, 902, 1, 5, 1, ""), ("z", 903, 1, 2, 0, "")]


def usable(rows):
    return [r for r in rows if r[0] and r[2] is not None and r[2] < r[3]]


def greedy(rows, key):
    taken = []
    for r in sorted(usable(rows), key=key):
        if all(r[0] != t[0] or r[3] <= t[2] or t[3] <= r[2] for t in taken):
            taken.append(r)
    return sorted((t[0], t[1]) for t in taken)


def walk(rows):
    taken, end = [], {}
    for r in sorted(usable(rows), key=lambda r: (r[2], r[1])):
        if r[2] >= end.get(r[0], -1):
            end[r[0]] = r[3]
            taken.append((r[0], r[1]))
    return sorted(taken)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_loops(spark, seed):
    rows = spans(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in first_disjoint(df, "grp", "sid", "a", "b").collect()) == walk(rows)
    assert sorted(tuple(r) for r in heaviest_disjoint(df, "grp", "sid", "a", "b", "w", 8).collect()) == greedy(rows, lambda r: (-r[4], r[1]))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert first_disjoint(none, "grp", "sid", "a", "b").collect() == [] and heaviest_disjoint(none, "grp", "sid", "a", "b", "w", 8).collect() == []
