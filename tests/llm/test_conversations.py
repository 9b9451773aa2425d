from __future__ import annotations

import random

import pytest

from tidemark.llm.conversations import assemble_fragments, export_fragments, read_rows, rebuild_conversations, rebuild_from_fragments

FR = "conversation long, fragment long, hashes array<long>, place string"
MS = "conversation long, message_id long, at long, author string, role string, visible boolean, opening boolean, position string"


def assemble(spark, frags):
    df = spark.createDataFrame([(*f, "clash") for f in frags], FR)
    return {r["fragment"]: (r["head"], r["offset"]) for r in assemble_fragments(df).collect()}


def test_overlaps_of_any_length_and_shuffled_ids(spark):
    frags = [(1, 30, [1, 2, 3, 4]), (1, 10, [3, 4, 5]), (1, 20, [5, 6]), (2, 40, [1, 2, 3, 4])]
    assert assemble(spark, frags) == {30: (30, 0), 10: (30, 2), 20: (30, 4), 40: (40, 0)}


@pytest.mark.parametrize("overlap", [1, 5, 50])
def test_long_overlaps_in_any_order(spark, overlap):
    step = 60
    frags = [(1, 7 * i % 11, list(range(step * i, step * i + step + overlap))) for i in range(6)]
    assert assemble(spark, frags) == {7 * i % 11: (0, step * i) for i in range(6)}


def test_contained_fragments_are_absorbed(spark):
    frags = [(1, 1, list(range(20))), (1, 2, list(range(5, 9))), (1, 3, list(range(15, 30))), (1, 4, list(range(20))[:4]), (1, 5, list(range(25, 30))), (1, 6, [6, 7])]
    assert assemble(spark, frags) == {1: (1, 0), 2: (1, 5), 3: (1, 15), 4: (1, 0), 5: (1, 25), 6: (1, 6)}


def test_gap_ambiguity_circle_and_copies(spark):
    assert assemble(spark, [(1, 1, [1, 2]), (1, 2, [3, 4])]) == {1: (1, 0), 2: (2, 0)}
    got = assemble(spark, [(1, 1, [1, 2]), (1, 2, [2, 3]), (1, 3, [2, 4])])
    assert {v[1] for v in got.values()} == {0}  # two successors: no link
    assert {v[1] for v in assemble(spark, [(1, 1, [1, 2]), (1, 2, [2, 1])]).values()} == {-1}
    assert assemble(spark, [(1, 1, [1, 2]), (1, 5, [1, 2]), (1, 2, [2, 3])]) == {1: (1, 0), 2: (1, 1)}


def test_longest_overlap_wins(spark):
    assert assemble(spark, [(1, 1, [7, 8, 7]), (1, 2, [8, 7, 9]), (1, 3, [9, 5])]) == {1: (1, 0), 2: (1, 1), 3: (1, 3)}


def test_no_and_empty_fragments(spark):
    assert assemble(spark, []) == {}
    assert assemble(spark, [(1, 1, []), (1, None, [1]), (1, 2, None)]) == {1: (1, 0)}


def msg(c, i, at, role="user", author="x", visible=True):
    return (c, i, at, author, role, visible, c == i, "clash")


def rebuild(spark, rows, page=2):
    conv, placed = rebuild_conversations(spark.createDataFrame(rows, MS), page)
    return {r["conversation"]: r for r in conv.collect()}, sorted((r["conversation"], r["position"], r["message_id"]) for r in placed.collect())


def test_reasons(spark):
    ok = [msg(1, 1, 10), msg(1, 3, 30, "assistant"), msg(1, 2, 20, "assistant"), msg(1, 4, 5, "system")]
    rows = ok + ok[:1] + [
        msg(100, 101, 1), msg(100, 102, 2, "assistant"),  # no opening
        msg(200, 200, 1), msg(200, 201, None, "assistant"),  # unknown time
        msg(300, 300, 1), msg(300, 301, 2, "assistant", None),  # no author
        msg(400, 400, 1, visible=False),  # empty
        msg(500, 500, 1, "assistant"), msg(500, 501, 2, "assistant"),
        msg(600, 600, 1), msg(600, 601, 2, "user"),
        msg(700, 700, 1, "system"), msg(700, 701, 2, "system"),
        msg(800, 800, 1), msg(800, 801, None, "assistant", None, False), msg(800, 802, 4, "assistant"),  # an invisible row does no harm
        (None, 5, 1, "x", "user", True, False, "clash"), (1, None, 1, "x", "user", True, False, "clash"),
    ]
    random.Random(1).shuffle(rows)
    got, placed = rebuild(spark, rows)
    why = {c: [k for k in ("no_opening", "unusable_row", "empty", "gap", "first_not_user", "last_not_assistant") if r[k]] for c, r in got.items()}
    assert why == {1: [], 100: ["no_opening"], 200: ["unusable_row", "last_not_assistant"], 300: ["unusable_row"], 400: ["empty"], 500: ["first_not_user"], 600: ["last_not_assistant"], 700: ["empty"], 800: []}
    assert [x for x in placed if x[0] == 1] == [(1, 0, 4), (1, 1, 1), (1, 2, 2), (1, 3, 3)]
    assert all(r["broken"] == bool(why[c]) for c, r in got.items())


def test_ties_by_id_and_a_long_conversation_over_many_pages(spark):
    n = 300
    rows = [msg(1, i, (i // 3) * 10, "user" if i % 2 else "assistant") for i in range(1, n + 1)]
    random.Random(2).shuffle(rows)
    got, placed = rebuild(spark, rows, page=4)
    assert not got[1]["broken"] and placed == [(1, i - 1, i) for i in range(1, n + 1)]


def test_a_missing_export_is_a_gap(spark):
    rows = [msg(c, c + i, i * 7_000_000 // (1 + i % 2), "user" if i % 2 == 0 else "assistant") for c in (1000, 5000) for i in range(100)]
    read = read_rows(spark.createDataFrame(rows, MS))
    frags = export_fragments(read.select("conversation", "message_id", "at", "author", "role"), 8)
    whole = frags.collect()
    assert sum(r["conversation"] == 1000 for r in whole) > 6 and max(len(r["hashes"]) for r in whole) <= 32
    rebuilt = lambda f: {r["conversation"]: r["gap"] for r in rebuild_from_fragments(read, f)[0].collect()}
    assert rebuilt(frags) == {1000: False, 5000: False}
    # Its neighbours overlap with it, but not with one another.
    order = sorted((r for r in whole if r["conversation"] == 1000), key=lambda r: r["own"][0]["at"])
    assert rebuilt(frags.where(frags["fragment"] != order[2]["fragment"])) == {1000: True, 5000: False}


def test_many_messages_of_one_hour_and_instant(spark):
    rows = [msg(1, i, 5 if i < 60 else i, "user" if i % 2 else "assistant") for i in range(1, 201)]
    random.Random(3).shuffle(rows)
    got, placed = rebuild(spark, rows, page=8)
    assert not got[1]["broken"] and placed == [(1, i - 1, i) for i in range(1, 201)]


def test_empty_table(spark):
    assert rebuild(spark, []) == ({}, [])
