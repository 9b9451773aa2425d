from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidemark.operators.sessions import sweep_sessions

SCHEMA = "entity string, at long, event_id long, action string, started_at string"


def plain(events, gap):
    """Sessions by a loop: (entity, first, last, n)."""
    seen, by = set(), {}
    for e, at, i, *_ in events:
        if e is not None and at is not None and i is not None and i not in seen:
            seen.add(i)
            by.setdefault(e, []).append((at, i))
    out = []
    for e, calls in by.items():
        calls.sort()
        cur = [calls[0]]
        for c in calls[1:]:
            if c[0] - cur[-1][0] > gap:
                out.append((e, cur[0][1], cur[-1][1], len(cur)))
                cur = []
            cur.append(c)
        out.append((e, cur[0][1], cur[-1][1], len(cur)))
    return sorted(out)


def run(spark, events, **kw):
    df = spark.createDataFrame([(*e, "clash") for e in events], SCHEMA)
    s = sweep_sessions(df, **kw)
    return sorted((r["entity"], r["first_id"], r["last_id"], r["n_events"]) for r in s.collect())


def test_exact_gap_joins_and_one_more_splits(spark):
    ev = [("a", 0, 1, "x"), ("a", 1000, 2, "x"), ("a", 2001, 3, "y")]
    assert run(spark, ev, gap_ms=1000, bucket_ms=300) == [("a", 1, 2, 2), ("a", 3, 3, 1)]


def test_nulls_copies_ties_and_negative_times(spark):
    ev = [("a", 5, 9, None), ("a", 5, 2, "x"), ("a", 5, 2, "x"), (None, 5, 3, "x"), ("a", None, 4, "x"), ("b", -7000, 6, "x"), ("b", -6500, 7, "x"), ("a", 6, None, "x")]
    assert run(spark, ev, gap_ms=1000, bucket_ms=1000) == [("a", 2, 9, 2), ("b", 6, 7, 2)]


def test_actions_and_duration(spark):
    ev = [("a", 0, 1, "r"), ("a", 10, 2, "w"), ("a", 20, 3, "r"), ("a", 20, 4, None)]
    r = sweep_sessions(spark.createDataFrame([(*e, "") for e in ev], SCHEMA), gap_ms=100).first()
    assert (r["started_at"], r["ended_at"], r["duration_ms"], r["actions"]) == (0, 20, 20, {"": 1, "r": 2, "w": 1})


def test_empty_table(spark):
    assert run(spark, []) == []


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="event_id"):
        sweep_sessions(spark.createDataFrame([("a", 1)], "entity string, at long"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(0, 40)), max_size=40), st.integers(1, 9))
def test_against_loop(spark, events, gap):
    ev, seen = [], set()
    for e, at, i in events:  # an id names one event
        if i not in seen:
            seen.add(i)
            ev.append((e, at, i, "x"))
    assert run(spark, ev, gap_ms=gap, bucket_ms=7) == plain(ev, gap)


def test_hot_entity_over_many_buckets_in_any_order(spark):
    rng = random.Random(3)
    ev = [("hot", rng.randrange(0, 50_000), i, "x") for i in range(600)] + [("b", 5, 1000, "x")]
    want = plain(ev, 150)
    rng.shuffle(ev)
    assert run(spark, ev, gap_ms=150, bucket_ms=500) == want
    assert rows(sweep_sessions(spark.createDataFrame([], SCHEMA))) == []
