from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm.vectors import adaptive_scan, nearest_in_tile, similar_vectors

DIM = 32


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in rows], "id long, vector array<float>, similarity string")


def brute(rows, least=0.8, k=5):
    ok = {}
    for i, v in rows:
        if i is None or v is None or len(v) != DIM or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault(i, np.array(v, dtype=np.float32).astype(float))
    ids = sorted(ok)
    x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    s = np.round(x @ x.T, 6)
    return {(ids[a], ids[b]) for a in range(len(ids)) for b in sorted((j for j in range(len(ids)) if j != a and s[a, j] >= least), key=lambda j: (-s[a, j], ids[j]))[:k]}


def clusters(seed=0, n=40, each=4):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        center = rng.standard_normal(DIM)
        rows += [(c * each + j, (center + 0.2 * rng.standard_normal(DIM)) * rng.uniform(0.1, 30)) for j in range(each)]
    return rows


def test_exact_on_small_data(spark):
    rows = clusters()
    got = {(r["id"], r["other_id"]) for r in similar_vectors(frame(spark, rows), least=0.8, dim=DIM).collect()}
    assert got == brute(rows)


def test_unusable_rows_copies_and_ranks(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(DIM)
    rows = [(i, v) for i in range(9)] + [(20, v * 3), (21, -v)]  # nine copies, one scaled, one opposite
    rows += [(30, None), (31, np.zeros(DIM)), (32, v[:5]), (33, np.where(np.arange(DIM) == 3, np.nan, v)), (34, np.where(np.arange(DIM) == 3, np.inf, v)), (None, v), (0, v)]
    rows += [(35, [None, *v[1:]]), (40, rng.standard_normal(DIM)), (41, v * 1e-30), (42, v * 1e30)]
    out = similar_vectors(frame(spark, rows), least=0.8, dim=DIM).collect()
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append((r["rank"], r["other_id"]))
    assert sorted(by) == [*range(9), 20, 41, 42]
    assert sorted(by[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and sorted(by[3]) == [(1, 0), (2, 1), (3, 2), (4, 4), (5, 5)]
    assert all(len(x) == 5 for x in by.values())


def test_recall_with_few_probes(spark):
    rows = clusters(2, 400, 3)
    got = {(r["id"], r["other_id"]) for r in similar_vectors(frame(spark, rows), least=0.8, dim=DIM, probes=1).collect()}
    want = brute(rows)
    assert not got - want and len(got & want) >= 0.9 * len(want)


def test_hot_list_is_tiled(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.vectors.TILE", 16)
    rows = clusters(3, 5, 30)
    assert {(r["id"], r["other_id"]) for r in similar_vectors(frame(spark, rows), least=0.8, dim=DIM).collect()} == brute(rows)


def test_adaptive_scan_keeps_true_neighbours():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:200] + 0.045 * rng.standard_normal((200, 128)).astype(np.float32)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    limit = np.full(500, 0.4)
    a, b, dist = adaptive_scan(near.astype(np.float32), x, limit[:200], limit)
    d = ((near[:, None, :] - x[None]) ** 2).sum(-1)
    want = set(zip(*np.nonzero(d <= 0.4)))
    assert len(set(zip(a, b)) & want) >= 0.99 * len(want) and set(zip(a, b)) <= set(zip(*np.nonzero(d <= 0.4001)))
    assert np.allclose(dist, d[a, b], atol=1e-4)


@pytest.mark.parametrize("n, m", [(300, 700), (1, 3), (3, 1), (20, 2000)])
def test_tile_keeps_the_nearest_of_both_sides(n, m):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((m, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(m) * 10
    q, qi = x[: min(n, m)], ids[: min(n, m)]
    got = {(r.a, r.b) for r in nearest_in_tile(qi, q, ids, x, 3).itertuples()}
    s = q.astype(float) @ x.T.astype(float)
    s[qi[:, None] == ids[None, :]] = -9
    rows = {(qi[a], ids[b]) for a in range(len(q)) for b in np.argsort(-s[a])[:3] if s[a, b] > -9}
    columns = {(qi[a], ids[b]) for b in range(m) for a in np.argsort(-s[:, b])[:3] if s[a, b] > -9}
    assert len(got & (rows | columns)) >= 0.97 * len(rows | columns) and len(got) <= 3 * (len(q) + m)


def test_a_dense_list_takes_little_memory():
    import resource

    rng = np.random.default_rng(9)
    v = rng.standard_normal(128)
    x = (v + 0.4 * rng.standard_normal((4096, 128))).astype(np.float32)  # every cosine is above 0.8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (x[:200] @ x.T).min() > 0.75
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = nearest_in_tile(np.arange(4096), x, np.arange(4096), x, 7, 0.5)
    assert 4096 * 7 <= len(out) <= 2 * 4096 * 7 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_empty_and_single(spark):
    assert similar_vectors(frame(spark, []), dim=DIM).collect() == []
    assert similar_vectors(frame(spark, [(1, np.ones(DIM))]), dim=DIM).collect() == []
    with pytest.raises(ValueError, match="vector"):
        similar_vectors(spark.range(1), dim=DIM)


def test_every_vector_gets_its_whole_top_five(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.standard_normal(DIM)
    rows = clusters(6, 20, 3) + [(1000 + i, rng.standard_normal(DIM)) for i in range(30)] + [(2000 + i, v) for i in range(8)] + [(3000, None)]
    want = brute(rows, least=-2)
    for tile in (12_288, 16):
        monkeypatch.setattr("tidemark.llm.vectors.EXACT_TILE", tile)
        out = similar_vectors(frame(spark, rows), dim=DIM).collect()
        assert {(r["id"], r["other_id"]) for r in out} == want and len(out) == 5 * 98
    few = similar_vectors(frame(spark, clusters(7, 3, 1)), dim=DIM).collect()
    assert sorted((r["id"], r["rank"]) for r in few) == [(i, j) for i in range(3) for j in (1, 2)]


def test_p3_neighbours_has_five_for_every_usable_vector(spark, duck):
    from tests.conftest import SF, rows
    from tidemark.llm.queries import QUERIES

    want = duck.sql("""WITH usable AS (SELECT id, min(list_transform(vector, lambda x: CAST(x AS DOUBLE))) AS v FROM code_embeddings WHERE id IS NOT NULL AND len(vector) = 128
  AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
pairs AS (SELECT a.id, b.id AS other_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM usable a JOIN usable b ON a.id <> b.id)
SELECT id, other_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other_id) AS rank FROM pairs) WHERE rank <= 5""").fetchall()
    got = rows(QUERIES["p3_neighbours"][0](spark, str(SF)).select("id", "other_id"))
    assert got == sorted(want, key=repr) and len(got) > 0


def test_lists_alone_find_most_of_the_whole_top_five(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.vectors.exact_nearest", lambda short, classes, k, dim: classes.sparkSession.createDataFrame([], "a long, b long, sim double"))
    rng = np.random.default_rng(10)
    centers = rng.standard_normal((30, DIM)) * 2
    rows = [(i, centers[i % 30] + rng.standard_normal(DIM)) for i in range(6000)]
    got = {(r["id"], r["other_id"]) for r in similar_vectors(frame(spark, rows), dim=DIM).collect()}
    want = brute(rows, least=-2)
    assert len(got & want) >= 0.95 * len(want)
