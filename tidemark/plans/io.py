"""Queries through the sources and sinks: written to the shared folder and read back, guarded SQL, browsing, extraction."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import cosine_unit
from tidemark.operators.selection import first_disjoint, heaviest_disjoint
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.runtime import load
from tidemark.sources import records, scan, sqlguard, store
from tidemark.streaming.feeds import not_expired
from tidemark.streaming.runner import stream_folder

family = Family()
query = family.query
P = V.PRELUDE


@query("S9 S12 S25", "SELECT event_id, user_id, event_type, CAST(value AS DOUBLE) AS value FROM events")
def jsonl_roundtrip(spark, d):
    """Events appended as JSON lines and read back by schema; torn lines would be skipped."""
    path = stream_folder(spark)
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    records.append_jsonl(e, path)
    return records.read_jsonl(spark, path, e.schema)


@query("S16 S17 S18 S22", P + "SELECT path, CASE WHEN tier = 'view' THEN 0 ELSE lines END AS lines FROM x_files WHERE tier <> 'atom'")
def replaced_table(spark, d):
    """A stored table of which some keys are replaced and some deleted."""
    path = f"{stream_folder(spark)}/files"
    f = V.files(spark, d).where("tier IS NOT NULL").select("path", "tier", "lines")
    store.replace_keys(spark, path, f, ["path"])
    store.replace_keys(spark, path, f.where("tier = 'view'").withColumn("lines", F.lit(0).cast("long")), ["path"])
    store.delete_keys(spark, path, f.where("tier = 'atom'").select("path"), ["path"])
    return spark.read.parquet(path).select("path", "lines")


@query("S26 S22", P + "SELECT priority, count(*) AS n FROM x_tasks WHERE priority IS NOT NULL GROUP BY priority")
def reimported_partitions(spark, d):
    """An import run twice: the partitions it touches are overwritten, so nothing counts double."""
    path = f"{stream_folder(spark)}/tasks"
    t = V.tasks(spark, d).where("priority IS NOT NULL").select("id", "priority")
    store.replace_partitions(t, path, ["priority"])
    store.replace_partitions(t.where("priority <= 2"), path, ["priority"])
    return spark.read.parquet(path).groupBy("priority").agg(F.count("*").alias("n"))


@query("S14", "SELECT 'calls' AS source, count(*) AS n, sum(id)::BIGINT AS ids FROM tool_calls UNION ALL SELECT 'feed', count(*), sum(id)::BIGINT FROM agent_feed")
def federated_read(spark, d):
    """Two ledgers under one schema with their source; a third that is missing is reported, not fatal."""
    schema = T.StructType([T.StructField("id", T.LongType())])
    frame, errors = records.federated(spark, {"calls": f"{d}/tool_calls.parquet", "feed": f"{d}/agent_feed.parquet", "none": f"{d}/absent.parquet"}, schema)
    if [e[0] for e in errors] != ["none"]:
        raise ValueError(f"unexpected sources: {errors}")
    return frame.groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("S27 S28 V3", "SELECT upper(r_name) AS r_name, r_regionkey FROM region")
def columnar_roundtrip(spark, d):
    """A page as {cols, rows} and back."""
    r = load(spark, d, "region")
    return records.from_columnar(spark, records.to_columnar(r, 200, {"r_name": F.upper("r_name")}), r.schema)


@query("S30", "SELECT column_index::INTEGER AS position, column_name AS name FROM duckdb_columns() WHERE table_name = 'files' AND schema_name = 'main'".replace("column_index::INTEGER", "(column_index - 1)::INTEGER"))
def table_structure(spark, d):
    return store.structure(load(spark, d, "files")).select("position", "name")


@query("S31 O4", P + "SELECT vid FROM x_violations ORDER BY vid LIMIT 50 OFFSET 100")
def browse_page(spark, d):
    return store.browse(V.violations(spark, d), "vid", page=3, limit=50).select("vid")


@query("S32 P19 P20", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def guarded_sql(spark, d):
    load(spark, d, "nation").createOrReplaceTempView("tidemark_nation")
    return sqlguard.read_only_sql(spark, "SELECT n_regionkey, count(*) AS n FROM tidemark_nation GROUP BY n_regionkey -- DROP TABLE x")


@query("S34", P + "SELECT tier, count(*) AS n FROM x_files GROUP BY tier")
def cached_result(spark, d):
    """A result stored under a key and read from the store."""
    folder = stream_folder(spark)
    build = lambda: V.files(spark, d).groupBy("tier").agg(F.count("*").alias("n"))
    store.cached(spark, folder, f"tiers of {d}", build)
    return store.cached(spark, folder, f"tiers of {d}", build)


@query("T14 T15 S21", P + """SELECT path, CASE WHEN content_hash IS NULL THEN 'remove' WHEN health_score < 70 THEN 'changed' WHEN mtime + 2000 >= synced_at THEN 'check' ELSE 'same' END AS action FROM x_files""")
def sync_actions(spark, d):
    """Plan of an incremental sync against a listing in which some files are gone and some have another size."""
    f = V.files(spark, d)
    listed = f.where("content_hash IS NOT NULL").select("path", "mtime", (F.col("size") + F.when(F.col("health_score") < 70, 1).otherwise(0)).alias("size"))
    return store.sync_plan(f, listed)


@query("S1 S2 S8", P + """, l AS (SELECT doc_kind, count(*) AS n FROM x_lines WHERE doc_kind IS NOT NULL GROUP BY doc_kind)
SELECT doc_kind AS folder, 'text' AS kind, n AS n_rows FROM l UNION ALL SELECT 'files', 'binary', count(*) FROM files UNION ALL SELECT 'build', 'binary', count(*) FROM symbols""")
def scanned_tree(spark, d):
    """A source tree of whole tables, scanned: texts and tables under src, and copies in folders that a scan leaves out, at the top or anywhere."""
    root = stream_folder(spark)
    texts = V.lines(spark, d).where("doc_kind IS NOT NULL").select("doc_kind", F.col("text").alias("value"))
    texts.write.partitionBy("doc_kind").text(f"{root}/src/texts")
    load(spark, d, "files").write.parquet(f"{root}/src/files")
    for path in ("src/build", "build", "src/vendor/symbols", "out/symbols"):
        load(spark, d, "symbols").write.parquet(f"{root}/{path}")
    found = scan.scan_tree(spark, root, None, ["**/_SUCCESS", "**/.*"])
    folder = F.regexp_extract("path", r"([^/=]+)/[^/]+$", 1)
    at = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    folders = found.groupBy(folder.alias("folder"), at.alias("at")).agg(F.min("kind").alias("kind"), F.bool_and(F.col("path").endswith(".parquet")).alias("is_table")).collect()  # one row per folder
    parts = []
    for r in folders:
        rows = spark.read.parquet(f"{root}/{r['at']}") if r["is_table"] else spark.read.text(f"{root}/{r['at']}")
        parts.append(rows.agg(F.lit(r["folder"]).alias("folder"), F.lit(r["kind"]).alias("kind"), F.count("*").alias("n_rows")))
    return reduce(DataFrame.unionByName, parts)


@query("S6 S7 V2", "SELECT count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents WHERE doc_kind = 'code') WHERE contains(line, 'return null')")
def literal_engines(spark, d):
    """Lines of written texts found by the engine that is a Python data source."""
    root = stream_folder(spark)
    load(spark, d, "documents").where("doc_kind = 'code'").select(F.explode(F.split("text", "\r?\n")).alias("value")).write.text(root)
    local = root.removeprefix("file:")
    engine = "datasource" if os.path.isdir(local) else "native"
    return scan.literal_search(spark, local if engine == "datasource" else root, "return null", engine=engine).agg(F.count("*").alias("n"))


@query("S10", "SELECT model AS agent, count(*) AS n, 'run of ' || model AS label FROM task_usage WHERE model <> 'unknown' GROUP BY model UNION ALL SELECT 'unknown', count(*), NULL FROM task_usage WHERE model = 'unknown'")
def run_folder(spark, d):
    """A run folder of journals by agent with label sidecars, one of which is missing."""
    folder = stream_folder(spark)
    u = load(spark, d, "task_usage").where("model IS NOT NULL").select(F.col("model").alias("agent"), F.lit(1).cast("long").alias("n"))
    u.write.partitionBy("agent").json(folder)
    labels = u.select("agent", F.concat(F.lit("run of "), "agent").alias("label")).distinct().where("agent <> 'unknown'")
    labels.write.partitionBy("agent").json(f"{folder}/meta")
    entry, meta = T.StructType([T.StructField("n", T.LongType())]), T.StructType([T.StructField("label", T.StringType())])
    return records.read_run(spark, folder, entry, meta).groupBy("agent", "label").agg(F.sum("n").alias("n"))


def _code(spark, d) -> DataFrame:
    return V.lines(spark, d).where("doc_kind = 'code'").withColumn("path", F.col("doc_id").cast("string"))


@query("S4 F21", P + """SELECT CAST(doc_id AS VARCHAR) AS path, line, CASE WHEN m[1] <> '' THEN m[1] WHEN m[4] <> '' THEN 'function' ELSE 'symbol' END AS kind, m[2] || m[3] || m[5] AS name, regexp_matches(text, '^\\s*export\\b') AS is_export
FROM (SELECT *, regexp_extract_all(text, '^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?(?:(function|class)\\s+([A-Za-z_$][\\w$]*)|(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)\\s*=|(def)\\s+([A-Za-z_]\\w*))', 0) AS all_, [regexp_extract(text, R, 1), regexp_extract(text, R, 2), regexp_extract(text, R, 3), regexp_extract(text, R, 4), regexp_extract(text, R, 5)] AS m FROM x_lines WHERE doc_kind = 'code') WHERE len(all_) > 0""".replace(
    "R, ", "'^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?(?:(function|class)\\s+([A-Za-z_$][\\w$]*)|(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)\\s*=|(def)\\s+([A-Za-z_]\\w*))', "))
def extracted_symbols(spark, d):
    return scan.extract_symbols(_code(spark, d)).select("path", "line", "kind", "name", "is_export")


@query("G6", P + """SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path, line, callee FROM (SELECT doc_id, line, unnest(regexp_extract_all(text, '([A-Za-z_$][\\w$]*)\\s*\\(', 1)) AS callee FROM x_lines WHERE doc_kind = 'code')
WHERE callee NOT IN ('if','for','while','switch','return','function','catch','def','elif','with')""")
def extracted_calls(spark, d):
    return scan.extract_calls(_code(spark, d)).select("path", "line", "callee")


@query("J4 M5", P + """, v AS (SELECT id, min(file_path) AS file_path, min(list_transform(vector, lambda x: CAST(x AS DOUBLE))) AS vector FROM code_embeddings WHERE len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY id),
q AS (SELECT vector FROM v WHERE id = (SELECT min(id) FROM v))
SELECT v.id, coalesce(f.tier, 'utility') AS tier, round(greatest(0, least(1, list_dot_product(v.vector, q.vector))), 4) AS similarity FROM v JOIN q ON true LEFT JOIN x_files f ON f.path = v.file_path WHERE list_dot_product(v.vector, q.vector) >= 0.25""")
def similar_with_file(spark, d, least: float = 0.25):
    """Vectors similar to a probe (the first id) with the tier of their file."""
    fine = (F.size("vector") == 128) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    e = load(spark, d, "code_embeddings").where(fine).groupBy("id").agg(F.min("file_path").alias("path"), F.min(F.col("vector").cast("array<double>")).alias("vector"))
    q = F.broadcast(e.orderBy("id").limit(1).select(F.col("vector").alias("q")))  # a single row
    s = e.crossJoin(q).select("id", "path", cosine_unit(F.col("vector"), F.col("q")).alias("c")).where(F.col("c") >= least)
    return s.join(V.files(spark, d).select("path", "tier"), "path", "left").select("id", F.coalesce("tier", F.lit("utility")).alias("tier"), F.round("c", 4).alias("similarity"))


@query("V1 M4", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 3) AS self FROM embeddings")
def sql_function(spark, d):
    """A SQL function registered once and used in SQL text."""
    V.vectors(spark, d).createOrReplaceTempView("tidemark_vectors")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)")
    return spark.sql("SELECT vec_id, round(vec_dot(CAST(embedding AS ARRAY<DOUBLE>), CAST(embedding AS ARRAY<DOUBLE>)), 3) AS self FROM tidemark_vectors")


@query("D8 T9", P + "SELECT id, CASE WHEN heartbeat IS NULL THEN 'holder dead' WHEN heartbeat + 864000000 <= 1775000000000 THEN 'expired' ELSE 'active' END AS lease FROM x_agents")
def lease_states(spark, d, now: int = 1_775_000_000_000):
    h = F.col("heartbeat")
    return V.agents(spark, d).select("id", F.when(h.isNull(), "holder dead").when(h + 864_000_000 <= now, "expired").otherwise("active").alias("lease"))


@query("A11", P + "SELECT telemetry_source IS NOT NULL AS is_measured, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM x_tasks GROUP BY 1")
def ablation(spark, d):
    """Measured against unmeasured tasks. Without data there is no row: nothing is simulated."""
    return V.tasks(spark, d).groupBy(F.col("telemetry_source").isNotNull().alias("is_measured")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


_SPANS = P + ", s AS (SELECT path, id, start_line AS a, end_line AS b FROM x_symbols WHERE path IS NOT NULL AND start_line < end_line)"


@query("W13", _SPANS + """, g AS (SELECT path, id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY a, id) AS r FROM s) WHERE r = 1
UNION ALL SELECT path, n.id, n.a, n.b FROM (SELECT g.path, arg_min({'id': s.id, 'a': s.a, 'b': s.b}, (s.a, s.id)) AS n FROM g JOIN s ON s.path = g.path AND s.a >= g.b GROUP BY g.path)) SELECT path, id FROM g""")
def first_disjoint_spans(spark, d):
    """Symbols that a greedy walk through each file takes without overlap."""
    return first_disjoint(V.symbols(spark, d), "path", "id", "start_line", "end_line")


@query("O11")
def heaviest_disjoint_spans(spark, d):
    """Longest disjoint symbols of each file. A greedy choice by weight has no oracle; tested against a loop."""
    s = V.symbols(spark, d).withColumn("mass", F.col("end_line") - F.col("start_line"))
    return heaviest_disjoint(s, "path", "id", "start_line", "end_line", "mass", 100)


@query("P3", "SELECT path FROM files WHERE starts_with(path, 'apps/') OR starts_with(path, 'kits/') GROUP BY path")
def merged_scope_files(spark, d):
    """Files of a union of scopes, one of which lies inside another."""
    from tidemark.plans.relational import in_scope, merge_scopes

    scopes = merge_scopes(["apps", "kits/token-sorter"], ["kits"])
    return V.files(spark, d).where(in_scope(F.col("path"), scopes)).select("path").distinct()


@query("V6 T4 V8", P + "SELECT id FROM x_agents WHERE state = 'idle'")
def mode_dispatch(spark, d, mode: str = "idle"):
    """A named mode chooses the query; an unknown one is an error."""
    modes = {"idle": lambda: V.agents(spark, d).where("state = 'idle'"), "live": lambda: not_expired(V.agents(spark, d), "heartbeat", 0)}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(modes)}")
    return modes[mode]().select("id")


@query("V4 V5", P + "SELECT kind, count(*) AS n, count(DISTINCT name) AS n_names FROM x_symbols WHERE name IS NOT NULL GROUP BY kind HAVING count(*) >= 3")
def injected_aggregates(spark, d):
    """A grouping whose aggregates and admission rule are given from outside."""
    aggregates = [F.count("*").alias("n"), F.count_distinct("name").alias("n_names")]
    admit = F.col("n") >= 3
    return V.symbols(spark, d).where("name IS NOT NULL").groupBy("kind").agg(*aggregates).where(admit)


QUERIES = family.queries
