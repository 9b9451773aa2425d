"""Graph and tree queries over task dependencies and file paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators.hierarchy import descendant_counts as counts_below
from tidemark.operators.hierarchy import resolve_hierarchy
from tidemark.operators.joins import first_of
from tidemark.plans import views as V
from tidemark.plans.registry import Family

family = Family()
query = family.query
P = V.PRELUDE

_REACH = P + """, r AS (SELECT id AS seed, id AS node, 0 AS depth FROM x_tasks WHERE state = 'blocked' UNION SELECT r.seed, e.src, r.depth + 1 FROM r JOIN x_edges e ON e.dst = r.node WHERE r.depth < 5),
b AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY seed, node)"""


def _consumers(spark, d, depth):
    t = V.tasks(spark, d)
    back = V.edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reach(back, t.where("state = 'blocked'").select(F.col("id").alias("seed")), depth)


@query("G2", _REACH + " SELECT seed, node, depth FROM b WHERE depth > 0")
def bfs_consumers(spark, d):
    """Whatever depends on a blocked task, at most five steps away."""
    return _consumers(spark, d, 5).where("depth > 0").select("seed", "node", "depth")


@query("G2 G7 G11", P + """, r AS (SELECT id AS seed, id AS node, 0 AS depth, [id] AS chain FROM x_tasks WHERE state = 'blocked'
UNION ALL SELECT r.seed, e.src, r.depth + 1, list_append(r.chain, e.src) FROM r JOIN x_edges e ON e.dst = r.node WHERE r.depth < 3 AND NOT list_contains(r.chain, e.src))
SELECT seed, node, min(depth) AS depth, arg_min(len(chain), depth) AS length FROM r GROUP BY seed, node""")
def consumer_chains(spark, d):
    """Shortest chains from a blocked task to its consumers; the chain's nodes are in the operator's result, its length here."""
    return G.chains(_consumers(spark, d, 3), 3).select("seed", "node", "depth", F.size("chain").cast("long").alias("length"))


@query("G3 G20", _REACH + """ SELECT b.seed, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, max(depth) AS max_depth, count(*) FILTER (t.tier = 'view') AS n_view
FROM b JOIN x_tasks t ON t.id = b.node WHERE depth > 0 GROUP BY b.seed""")
def blast_radius(spark, d):
    tier = V.tasks(spark, d).select(F.col("id").alias("node"), "tier")
    r = _consumers(spark, d, 5).where("depth > 0").join(tier, "node")
    return r.groupBy("seed").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.max("depth").alias("max_depth"), F.count_if(F.col("tier") == "view").alias("n_view"))


@query("G4", P + "SELECT DISTINCT path FROM x_symbols WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM x_files) AND name ILIKE '%token%'")
def unresolved_importers(spark, d):
    s = V.symbols(spark, d).where(F.col("path").isNotNull() & F.col("name").ilike("%token%")).select("path").distinct()
    return s.join(V.files(spark, d).select("path"), "path", "left_anti")


@query("G5", P + """, r AS (SELECT id AS seed, id AS node, 0 AS depth FROM x_tasks WHERE state = 'review' UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN x_edges e ON e.src = r.node WHERE r.depth < 3)
SELECT seed, node, min(depth) AS depth FROM r GROUP BY seed, node""")
def forward_trace(spark, d):
    """What a task in review depends on, to three steps; shortest depth (the walk order of a depth-first search does not matter)."""
    return G.reach(V.edges(spark, d), V.tasks(spark, d).where("state = 'review'").select(F.col("id").alias("seed")), 3).select("seed", "node", "depth")


@query("G7 R48", P + "SELECT id, id NOT IN (SELECT src FROM x_edges) AS is_root, id NOT IN (SELECT dst FROM x_edges) AS is_leaf FROM x_tasks")
def roots_and_leaves(spark, d):
    e = V.edges(spark, d)
    src = e.select(F.col("src").alias("id")).distinct().withColumn("has_out", F.lit(True))
    dst = e.select(F.col("dst").alias("id")).distinct().withColumn("has_in", F.lit(True))
    t = V.tasks(spark, d).select("id").join(src, "id", "left").join(dst, "id", "left")
    return t.select("id", F.col("has_out").isNull().alias("is_root"), F.col("has_in").isNull().alias("is_leaf"))


@query("G1", P + """, hits AS (SELECT path, 1 AS stage FROM x_files WHERE path = 'hash-token.js' UNION ALL SELECT path, 2 FROM x_files WHERE ends_with(path, '/hash-token.js') UNION ALL SELECT path, 3 FROM x_symbols WHERE name = 'hash-token.js' AND path IS NOT NULL
UNION ALL SELECT path, 4 FROM x_files WHERE contains(path, 'hash-token.js')) SELECT DISTINCT path, stage FROM hits WHERE stage = (SELECT min(stage) FROM hits)""")
def seed_cascade(spark, d, text: str = "hash-token.js"):
    """Candidates of the first stage that finds any: exact path, suffix, symbol name, substring."""
    f, s = V.files(spark, d), V.symbols(spark, d).where("path IS NOT NULL")
    p = F.col("path")
    stages = [f.where(p == text), f.where(p.endswith("/" + text)), s.where(F.col("name") == text), f.where(p.contains(text))]
    hits = None
    for i, x in enumerate(stages, 1):
        x = x.select("path", F.lit(i).alias("stage"))
        hits = x if hits is None else hits.unionByName(x)
    first = F.broadcast(hits.agg(F.min("stage").alias("stage")))  # a single row
    return hits.join(first, "stage").select("path", "stage").distinct()


@query("G8 G9", P + """, k AS (SELECT path, unnest(list_distinct([path, regexp_replace(path, '\\.[A-Za-z0-9]+$', ''), regexp_replace(path, '/index\\.[A-Za-z0-9]+$', '')])) AS module FROM x_files)
SELECT s.id, min(k.path) AS resolved FROM x_symbols s JOIN k ON k.module = regexp_replace(s.path, '\\.[A-Za-z0-9]+$', '') GROUP BY s.id""")
def module_resolution(spark, d):
    """Module keys of files (whole path, without extension, folder of an index file) and the first file of each reference's key."""
    bare = lambda c: F.regexp_replace(c, r"\.[A-Za-z0-9]+$", "")
    keys = V.files(spark, d).select("path", F.explode(F.array_distinct(F.array(F.col("path"), bare("path"), F.regexp_replace("path", r"/index\.[A-Za-z0-9]+$", "")))).alias("module"))
    first = keys.groupBy("module").agg(F.min("path").alias("resolved"))
    return V.symbols(spark, d).where("path IS NOT NULL").select("id", bare("path").alias("module")).join(first, "module").select("id", "resolved")


@query("G10 G12", P + """, merged AS (SELECT src, dst FROM x_edges UNION SELECT id, task_id FROM x_feed WHERE task_id IS NOT NULL AND id <> task_id AND task_id IN (SELECT id FROM x_tasks) AND id IN (SELECT id FROM x_tasks)),
reasons AS (SELECT id AS node, 'changed' AS reason FROM x_tasks WHERE state = 'review' UNION SELECT src, 'direct' FROM merged WHERE dst IN (SELECT id FROM x_tasks WHERE state = 'review'))
SELECT node, string_agg(reason, ',' ORDER BY reason) AS reasons FROM reasons GROUP BY node""")
def affected_with_reasons(spark, d):
    """Nodes a change touches, with all reasons: edges of two sources are merged, each reason once."""
    t = V.tasks(spark, d)
    known = t.select("id")
    posts = V.feed(spark, d).where("task_id IS NOT NULL AND id <> task_id").select(F.col("id").alias("src"), F.col("task_id").alias("dst"))
    posts = posts.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    merged = V.edges(spark, d).unionByName(posts.select("src", "dst")).distinct()
    changed = t.where("state = 'review'").select("id")
    reasons = changed.select(F.col("id").alias("node"), F.lit("changed").alias("reason")).union(
        merged.join(changed.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", F.lit("direct"))).distinct()
    return reasons.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


_TREE = P + """, n AS (SELECT h.id, p.id AS up, h.total_tokens, h.telemetry_source FROM x_tasks h LEFT JOIN x_tasks p ON p.id = h.parent_id AND h.parent_id <> 0),
t AS (SELECT id AS top, id FROM n WHERE up IS NULL UNION ALL SELECT t.top, n.id FROM t JOIN n ON n.up = t.id)"""


@query("G13 G14", _TREE + """, u AS (SELECT task_id, sum(total_tokens)::BIGINT AS imported FROM x_usage WHERE task_id IS NOT NULL GROUP BY task_id)
SELECT t.top, count(*) AS n_tasks, sum(CASE WHEN n.telemetry_source = 'own' THEN n.total_tokens ELSE u.imported END)::BIGINT AS tokens, count(*) FILTER (CASE WHEN n.telemetry_source = 'own' THEN n.total_tokens ELSE u.imported END IS NULL) AS n_unknown
FROM t JOIN n ON n.id = t.id LEFT JOIN u ON u.task_id = t.id GROUP BY t.top""")
def tree_rollup(spark, d):
    """Tokens of whole task trees: own telemetry, else imported usage, else unknown (never zero)."""
    t = V.tasks(spark, d)
    top = resolve_hierarchy(t.select("id", F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent_id"))).where("depth >= 0").select("id", F.col("root_id").alias("top"))
    u = V.usage(spark, d).where("task_id IS NOT NULL").groupBy(F.col("task_id").alias("id")).agg(F.sum("total_tokens").alias("imported"))
    own = F.when(F.col("telemetry_source") == "own", F.col("total_tokens")).otherwise(F.col("imported"))
    rows = top.join(t.select("id", "telemetry_source", "total_tokens"), "id").join(u, "id", "left").select("top", own.alias("tokens"))
    return rows.groupBy("top").agg(F.count("*").alias("n_tasks"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("n_unknown"))


@query("R55", P + "SELECT parent_id FROM x_tasks WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) FILTER (state NOT IN ('done', 'duplicate', 'cancelled', 'deleted')) = 0")
def closable_parents(spark, d):
    t = V.tasks(spark, d).where("parent_id IS NOT NULL")
    return t.groupBy("parent_id").agg(F.count_if(~F.col("state").isin(V.CLOSED)).alias("n_open")).where("n_open = 0").select("parent_id")


@query("R48 G13", _TREE.replace("t AS (SELECT id AS top, id FROM n WHERE up IS NULL UNION ALL SELECT t.top, n.id FROM t JOIN n ON n.up = t.id)",
    "t AS (SELECT id, [id] AS chain FROM n WHERE up IS NULL UNION ALL SELECT n.id, list_append(t.chain, n.id) FROM t JOIN n ON n.up = t.id)") + " SELECT id, array_to_string(chain, '>') AS ancestors FROM t")
def ancestor_chains(spark, d):
    t = V.tasks(spark, d).select("id", F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent_id"))
    r = resolve_hierarchy(t, with_paths=True).where("path IS NOT NULL")
    return r.select("id", F.array_join(F.col("path").cast("array<string>"), ">").alias("ancestors"))


@query("G13", P + """, n AS (SELECT h.id, p.id AS up FROM x_tasks h LEFT JOIN x_tasks p ON p.id = h.parent_id AND h.parent_id <> 0),
climbs AS (SELECT id, id AS top, [id] AS seen FROM n UNION ALL SELECT c.id, n.up, list_append(c.seen, n.up) FROM climbs c JOIN n ON n.id = c.top WHERE n.up IS NOT NULL AND NOT list_contains(c.seen, n.up))
SELECT top, count(*) - 1 AS n_below FROM climbs GROUP BY top""")
def descendant_counts(spark, d):
    t = V.tasks(spark, d).select("id", F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent_id"))
    return counts_below(t).select(F.col("ancestor_id").alias("top"), "n_below")


@query("G15 G16", P + """, e AS (SELECT src, dst FROM x_edges UNION SELECT dst, src FROM x_edges), r AS (SELECT DISTINCT src AS node, src AS reached FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reached)
SELECT node, min(reached) AS component FROM r GROUP BY node""")
def task_components(spark, d):
    """Connected components of the dependency graph."""
    return G.components(V.edges(spark, d))


@query("G15", P + """, b AS (SELECT DISTINCT target_path, id FROM x_tasks WHERE target_path IS NOT NULL) SELECT target_path, min(id) AS component, count(*) AS n FROM b GROUP BY target_path""")
def file_components(spark, d):
    """Tasks that share a file: each file is one group."""
    return V.tasks(spark, d).where("target_path IS NOT NULL").groupBy("target_path").agg(F.min("id").alias("component"), F.count("*").alias("n"))


@query("G18", P + """, p AS (SELECT string_split(path, '/') AS parts FROM x_files), x AS (SELECT parts, unnest(range(1, len(parts))) AS k FROM p)
SELECT array_to_string(parts[1:k], '/') AS folder, k AS depth, count(*) AS n_files FROM x GROUP BY 1, 2""")
def file_tree(spark, d):
    return G.path_tree(V.files(spark, d), "path").select("folder", F.col("depth").cast("long").alias("depth"), "n_files")


@query("R52", P + "SELECT task_id, arg_min(author, (coalesce(moment, 9e18), id)) AS creator FROM x_feed WHERE task_id IS NOT NULL AND author IS NOT NULL GROUP BY task_id")
def task_creators(spark, d):
    f = V.feed(spark, d).where("task_id IS NOT NULL AND author IS NOT NULL").withColumn("t", F.coalesce("at", F.lit(9 * 10**18)))
    return first_of(f, ["task_id"], [F.col("t"), F.col("id")]).select("task_id", F.col("author").alias("creator"))


QUERIES = family.queries
