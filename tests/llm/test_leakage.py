from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.leakage import find_matches, leaked_items, leaked_passages, remove_leaked, suffix_array, words_of

W = [f"w{i}" for i in range(60)]


def test_words_of():
    assert words_of("// <b>Foo</b>-Bar, ﬁ² b​ar<br/>x_y ＡＢ") == ["foo", "bar", "fi2", "bar", "x", "y", "ab"]
    assert words_of(None) == [] and words_of("  ") == [] and words_of("a < b > c") == ["a", "b", "c"]
    assert words_of("Straße İx") == ["straße", "i", "x"]


def plain(docs, items, n):
    out = set()
    for i, t in items:
        w = words_of(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(i, d) for d, x in docs if (y := words_of(x)) and any(tuple(y[k : k + n]) in grams for k in range(len(y) - n + 1))}
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    return leaked_items(d, i, **kw)


def test_boundaries_and_matches(spark):
    item = " ".join(W[:20])
    docs = [(1, "x " + " ".join(W[:10]) + " y"), (2, " ".join(W[:9]) + " y " + " ".join(W[9:18])), (3, "\n".join(f"// {w}," for w in W[5:20])), (4, None), (5, ""), (6, item), (6, item), (None, item)]
    got = run(spark, docs, [(7, item), (8, None), (None, item)])
    assert sorted(tuple(r) for r in got.collect()) == [(7, 1, 10, 0, 1), (7, 3, 15, 5, 0), (7, 6, 20, 0, 0)]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in remove_leaked(corpus.where("doc_id IS NOT NULL"), got).collect()) == [2, 4, 5]


@pytest.mark.parametrize("item_words, shard_words", [(50, 300), (500_000, 2_000_000)])
def test_against_all_windows(spark, item_words, shard_words):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(W[:8], k=30))) for i in range(12)]
    docs = [(d, " ".join(rng.choices(W[:8], k=80))) for d in range(60)]
    docs += [(100 + i, " ".join([*rng.choices(W, k=5), *t.split()[3:16], *rng.choices(W, k=5)])) for i, t in items]
    got = run(spark, docs, items, min_words=6, item_words=item_words, shard_words=shard_words)
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == plain(docs, items, 6) and got.count() == len(plain(docs, items, 6))


def test_very_long_document_and_empty_tables(spark):
    item = " ".join(W[:12])
    docs = [(1, " ".join(W[i % 60] + str(i) for i in range(60_000)) + " " + item)]
    assert [r["doc_word"] for r in run(spark, docs, [(1, item)]).collect()] == [60_000]
    assert run(spark, [], [(1, item)]).collect() == [] and run(spark, docs, []).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 3), min_size=1, max_size=60), st.lists(st.integers(-1, 3), max_size=30), st.integers(1, 11))
def test_matches_against_loop(text, test, depth):
    d, t = np.array(text, dtype=np.int64), np.array(test, dtype=np.int64)
    order = suffix_array(d)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    want = set()
    for i in range(len(test)):
        for j in range(len(text)):
            n = 0
            while i + n < len(test) and j + n < len(text) and test[i + n] == text[j + n] >= 0:
                n += 1
            if n >= depth and not (i and j and test[i - 1] == text[j - 1] >= 0):
                want.add((i, j, n))
    a, b, n = find_matches(d, order, t, depth)
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == sorted(want)


def test_repetitive_text_gives_each_match_once():
    text, test = np.zeros(20_000, dtype=np.int64), np.zeros(2_000, dtype=np.int64)
    a, b, n = find_matches(text, suffix_array(text), test, 10)
    # One match for each way to lay one row of equal words beside the other.
    assert len(a) == 20_000 + 2_000 - 1 - 2 * 9 and n.max() == 2_000 and ((a == 0) | (b == 0)).all()


def test_all_places_of_an_item(spark):
    item = " ".join(W[:12])
    docs = [(1, f"{item} x {item}"), (2, item), (2, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = leaked_passages(d, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(7, 1, 12, 0, 0), (7, 1, 12, 0, 13), (7, 2, 12, 0, 0)]
