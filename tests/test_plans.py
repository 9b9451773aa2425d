"""Physical plans: what is read, pushed down, and never done."""

from __future__ import annotations

import re

import pytest

from tests.conftest import SF
from tidemark.plans import views as V
from tidemark.plans.catalog import catalog

CATALOG = catalog()
#: These attach a single row or a fixed small table by a cross join, which a nested loop does at no cost.
SINGLE_ROW = {
    "page_of_tasks", "velocity", "slop_score", "audit_freshness", "best_per_target", "sparkline", "bm25_search", "cosine_filter", "within_duration", "unmerged_rows", "similar_with_file",
}
EAGER = {n for n in CATALOG if n.startswith(("p4_", "tail_", "status_stream", "session_stream", "maxima_", "lease_stream", "job_stream"))} | {
    "bfs_consumers", "consumer_chains", "blast_radius", "forward_trace", "tree_rollup", "ancestor_chains", "descendant_counts", "task_components", "title_clusters", "jaccard_pairs",
    "first_disjoint_spans", "heaviest_disjoint_spans", "jsonl_roundtrip", "replaced_table", "reimported_partitions", "federated_read", "cached_result", "scanned_tree", "literal_engines",
    "run_folder", "near_vectors", "columnar_roundtrip", "emptiness_probe",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(CATALOG) - EAGER))
def test_no_product_of_two_tables(spark, duck, name):
    text = plan(CATALOG[name][0](spark, str(SF)))
    assert "CartesianProduct" not in text
    if name not in SINGLE_ROW:
        assert "BroadcastNestedLoopJoin" not in text


def schema_of(text: str, table: str) -> set[str]:
    m = re.search(rf"FileScan parquet \[[^\]]*\][^\n]*{table}\.parquet[^\n]*ReadSchema: struct<([^>]*)>", text)
    return {c.split(":")[0] for c in m[1].split(",")}


def test_unused_columns_are_not_read(spark, duck):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    d = str(SF)
    assert schema_of(plan(V.files(spark, d).select("path", "lines")), "files") == {"path", "lines"}
    assert schema_of(plan(V.tasks(spark, d).select("id", "title")), "agent_tasks") == {"id", "title", "updated_at", "status", "priority", "parent_id", "total_tokens"}
    assert schema_of(plan(CATALOG["counterfactual_totals"][0](spark, d)), "tool_calls") == {"id", "result_chars", "cf_kind", "cf_chars", "cf_calls"}
    assert schema_of(plan(CATALOG["p2_found"][0](spark, d)), "tool_calls") == {"id", "ts", "agent"}
    assert schema_of(plan(CATALOG["p5_found"][0](spark, d)), "task_usage") <= {"run_id", "agent_id", "imported_at", "started_at", "total_tokens", "cost_usd"}


def test_filters_reach_the_scan(spark, duck):
    text = plan(CATALOG["k_row_windows"][0](spark, str(SF)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in text
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,7)" in plan(CATALOG["rule_groups"][0](spark, str(SF)))


def test_hot_paths_have_no_python(spark, duck):
    for name in ("p2_found", "p2_sessions", "p5_found", "p6_found", "posts_in_windows", "span_containment", "bm25_search", "exact_buckets"):
        assert "Python" not in plan(CATALOG[name][0](spark, str(SF))) and "Pandas" not in plan(CATALOG[name][0](spark, str(SF))), name


def test_no_local_checkpoint_in_the_library():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "tidemark"
    assert not [p for p in root.rglob("*.py") if "localCheckpoint" in p.read_text()]


def test_rows_without_code_are_not_claimed():
    from scripts.coverage import OTHER
    from tidemark.plans.catalog import coverage

    claimed = {r for rows in coverage().values() for r in rows}
    for row in ("F14", "F15", "R6"):
        assert row not in claimed and OTHER[row].startswith(("left out", "missing"))


def test_k_row_windows_of_two_to_six_rows(spark, duck):
    from collections import Counter

    from tests.conftest import SF

    flags = {}
    for order, line, flag in duck.sql("SELECT l_orderkey, l_linenumber, min(l_returnflag) FROM lineitem GROUP BY ALL").fetchall():
        flags.setdefault(order, {})[line] = flag
    want = Counter((k, ",".join(f[i + j] for j in range(k))) for f in flags.values() for i in f for k in range(2, 7) if all(i + j in f for j in range(k)))
    got = CATALOG["k_row_windows"][0](spark, str(SF)).collect()
    assert {(r["k"], r["window_key"]): r["n"] for r in got} == want and {k for k, _ in want} == {2, 3, 4, 5, 6}
