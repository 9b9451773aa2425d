from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import hierarchy as H
from tidemark.operators.hierarchy import all_descendants, descendants, resolve_hierarchy


def plain(links):
    known = dict(links)
    out = {}
    for n in known:
        path, cur = [n], n
        while True:
            up = known[cur]
            if up is None or up not in known:
                out[n] = (cur, len(path) - 1)
                break
            if up in path:
                out[n] = (min(path[path.index(up):]), -1)
                break
            path.append(up)
            cur = up
    return out


def run(spark, links, **kw):
    df = spark.createDataFrame([(a, b, "clash") for a, b in links], "id long, parent_id long, root_id string")
    return resolve_hierarchy(df, **kw)


def test_chain_star_dangling_and_loops(spark):
    links = [(i, i - 1) for i in range(1, 40)] + [(0, None), (100, 999), (101, 100), (200, 201), (201, 202), (202, 200), (203, 200), (204, 203), (300, 300), (301, 300)]
    links += [(i, 100) for i in range(400, 430)]
    r = {x["id"]: x for x in run(spark, links, with_paths=True).collect()}
    assert {k: (v["root_id"], v["depth"]) for k, v in r.items()} == plain(links)
    assert r[3]["path"] == [0, 1, 2, 3] and r[204]["path"] is None and r[39]["path"] == list(range(40))


def test_repeats_conflicts_nulls_and_empty(spark):
    r = {x["id"]: (x["root_id"], x["depth"]) for x in run(spark, [(1, None), (2, 1), (2, 1), (3, 2), (3, 1), (None, 1)]).collect()}
    assert r == {1: (1, 0), 2: (1, 1), 3: (1, 1)}
    assert run(spark, []).collect() == []


def test_only_loops(spark):
    links = [(i, (i + 1) % 9) for i in range(9)]
    assert {x["id"]: (x["root_id"], x["depth"]) for x in run(spark, links).collect()} == plain(links)


def test_long_tail_below_a_loop(spark):
    links = [(1, 2), (2, 1)] + [(i, i - 1) for i in range(3, 45)]
    assert {x["id"]: (x["root_id"], x["depth"]) for x in run(spark, links).collect()} == plain(links)


def test_descendants(spark):
    d = descendants(run(spark, [(1, None), (2, 1), (3, 2), (9, 9)], with_paths=True))
    assert sorted(tuple(x) for x in d.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0)]


def walked_pairs(known):
    out = set()
    for n in known:
        seen, cur = [], n
        while cur in known and cur not in seen:
            seen.append(cur)
            cur = known[cur]
        out |= {(a, n, i) for i, a in enumerate(seen)}
    return out


def pairs(spark, known):
    return sorted(tuple(x) for x in all_descendants(spark.createDataFrame(list(known.items()), "id long, parent_id long")).collect())


def test_descendants_on_and_below_loops(spark):
    known = {1: None, 2: 1, 5: 7, 6: 5, 7: 6, 8: 6, 9: 8, 10: 5, 20: 20, 21: 20, 30: 99}
    assert pairs(spark, known) == sorted(walked_pairs(known))
    assert pairs(spark, {1: None, 2: 1}) == [(1, 1, 0), (1, 2, 1), (2, 2, 0)]


@settings(max_examples=4, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.one_of(st.none(), st.integers(1, 16)), min_size=1, max_size=15))
def test_all_descendants_against_walk(spark, known):
    assert pairs(spark, known) == sorted(walked_pairs(known))


def test_p4_descendants_of_every_task(spark, duck):
    from tests.conftest import SF, rows
    from tidemark.plans.catalog import catalog
    from tidemark.plans.pipeline import QUERIES

    links = duck.sql("""WITH held AS (SELECT id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS k
FROM agent_tasks WHERE id IS NOT NULL) WHERE k = 1) SELECT h.id, p.id FROM held h LEFT JOIN held p ON p.id = h.parent_id AND h.parent_id <> 0""").fetchall()
    want = walked_pairs(dict(links))
    got = QUERIES["p4_descendants"][0](spark, str(SF)).select("ancestor_id", "id", "distance")
    assert rows(got) == sorted(want, key=repr)
    below = rows(catalog()["descendant_counts"][0](spark, str(SF)).select("top", "n_below"))
    assert below == sorted(((i, sum(a == i for a, _, _ in want) - 1) for i in dict(links)), key=repr)


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.one_of(st.none(), st.integers(1, 30)), min_size=1, max_size=25))
def test_against_walk(spark, known):
    links = list(known.items())
    assert {x["id"]: (x["root_id"], x["depth"]) for x in run(spark, links).collect()} == plain(links)


def tangled(n=60):
    """Trees, a long chain, self-parents, loops of two and five with long tails, and dangling parents."""
    pick = random.Random(5)
    known = {i: pick.choice([None, 999, pick.randrange(1, n)]) for i in range(1, n)}
    known |= {100 + i: 99 + i for i in range(1, 40)} | {100: None, 200: 200, 201: 200, 300: 301, 301: 300}
    known |= {400 + i: 400 + (i + 1) % 5 for i in range(5)} | {405 + i: (404 + i if i else 402) for i in range(30)}
    return known


@pytest.mark.parametrize("limit", [0, 25, 10**6])
def test_rounds_and_one_task_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "IN_ONE_TASK", limit)
    known = tangled()
    assert {x["id"]: (x["root_id"], x["depth"]) for x in run(spark, list(known.items())).collect()} == plain(known.items())
    weighted = spark.createDataFrame([(i, p, i % 7) for i, p in known.items()], "id long, parent_id long, w long")
    got = {x["id"]: x["depth"] for x in resolve_hierarchy(weighted, weight="w").where("depth >= 0").collect()}
    far = lambda i: 0 if known[i] not in known else i % 7 + far(known[i])
    assert got == {i: far(i) for i, (_, depth) in plain(known.items()).items() if depth >= 0}


@pytest.mark.parametrize("limit,most", [(0, 10), (10**6, 2)])
def test_many_small_loops_take_no_more_rounds(spark, monkeypatch, limit, most):
    monkeypatch.setattr(H, "IN_ONE_TASK", limit)
    cuts = []
    for name in ("cut", "cut_counting"):
        monkeypatch.setattr(H, name, lambda *a, f=getattr(H, name): cuts.append(1) or f(*a))
    known = {i: i ^ 1 for i in range(1000, 3000)} | {1: None, 2: 1, 3: 2}
    got = {x["id"]: (x["root_id"], x["depth"]) for x in run(spark, list(known.items())).collect()}
    assert got == plain(known.items()) and len(cuts) <= most


@pytest.mark.parametrize("limit", [0, 10**6])
def test_descendant_counts_without_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "IN_ONE_TASK", limit)
    known = tangled()
    want = dict.fromkeys(known, -1)
    for a, _, _ in walked_pairs(known):
        want[a] += 1
    # A chain of 3,000 has 4.5 million pairs and 3,000 counts.
    known |= {10_000 + i: 9_999 + i for i in range(1, 3000)} | {10_000: None}
    want |= {10_000 + i: 2999 - i for i in range(3000)}
    monkeypatch.setattr(H, "all_descendants", None)
    nodes = spark.createDataFrame(list(known.items()), "id long, parent_id long")
    assert {r["ancestor_id"]: r["n_below"] for r in H.descendant_counts(nodes).collect()} == want
    assert H.descendant_counts(nodes.limit(0)).collect() == []
