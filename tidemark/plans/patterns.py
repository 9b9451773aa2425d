"""Duplicate shapes: fingerprint buckets, near-duplicate names, set similarity, templates, drift, folding, ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.blocks import block_search
from tidemark.operators.graph import components
from tidemark.operators.joins import overlapping
from tidemark.operators.similarity import set_similarity, templates
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.plans.text import SET_SQL, set_digest

family = Family()
query = family.query
P = V.PRELUDE

_FACET = "regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)"
_UNITS = P + f""", u AS (SELECT id, path, kind, {_FACET} AS facet, name AS fp1, lower(replace(name, '_', '')) AS fp2, kind || ':' || (end_line - start_line) AS fp3, end_line - start_line AS mass, start_line, end_line FROM x_symbols WHERE path IS NOT NULL AND name IS NOT NULL)"""


def units(spark, d):
    """Code units: symbols with three fingerprints (exact name, name without case and marks, shape) and their mass."""
    s = V.symbols(spark, d).where("path IS NOT NULL AND name IS NOT NULL")
    mass = F.col("end_line") - F.col("start_line")
    return s.select(
        "id", "path", "kind", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("facet"), F.col("name").alias("fp1"),
        F.lower(F.translate("name", "_", "")).alias("fp2"), F.concat_ws(":", "kind", mass).alias("fp3"), mass.alias("mass"), "start_line", "end_line")


@query("F1 S33", _UNITS + """, x AS (SELECT kind, facet, 1 AS level, fp1 AS fp, path FROM u UNION ALL SELECT kind, facet, 2, fp2, path FROM u UNION ALL SELECT kind, facet, 3, fp3, path FROM u WHERE fp3 IS NOT NULL)
SELECT kind, facet, level, fp, count(*) AS n, count(DISTINCT path) AS n_files FROM x GROUP BY ALL HAVING count(DISTINCT path) >= 2""")
def exact_buckets(spark, d):
    """Equal fingerprints at three levels in two files or more."""
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"fp{i}").alias("fp")) for i in (1, 2, 3)])).alias("l")
    x = units(spark, d).select("kind", "facet", "path", levels).select("kind", "facet", "path", "l.level", "l.fp").where("fp IS NOT NULL")
    return x.groupBy("kind", "facet", "level", "fp").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files")).where("n_files >= 2")


@query("F3", _UNITS + " SELECT facet, fp2, count(DISTINCT fp1) AS n_names, count(*) AS n FROM u GROUP BY facet, fp2 HAVING count(DISTINCT path) >= 2 AND count(DISTINCT fp1) >= 2")
def named_duplicates(spark, d):
    g = units(spark, d).groupBy("facet", "fp2").agg(F.count_distinct("fp1").alias("n_names"), F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))
    return g.where("n_files >= 2 AND n_names >= 2").select("facet", "fp2", "n_names", "n")


_SETS = P + """, s AS (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w <> ''))) AS items FROM x_tasks WHERE title IS NOT NULL),
c AS (SELECT items, min(id) AS class_id, count(*) AS n FROM s GROUP BY items),
l AS (SELECT least(a.class_id, b.class_id) AS class_a, greatest(a.class_id, b.class_id) AS class_b, len(list_intersect(a.items, b.items)) AS same, len(a.items) + len(b.items) AS total FROM c a JOIN c b ON a.class_id < b.class_id AND len(a.items) > 0 AND len(b.items) > 0
  AND len(a.items) >= 0.8 * len(b.items) AND len(b.items) >= 0.8 * len(a.items))"""


def _title_sets(spark, d):
    words = F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda w: w != "")
    return V.tasks(spark, d).where("title IS NOT NULL").select("id", words.alias("items"))


@query("U12 J24 F4", _SETS + " SELECT class_a, class_b, round(same / (total - same), 6) AS jaccard FROM l WHERE same >= 0.8 * (total - same) - 1e-9")
def jaccard_pairs(spark, d):
    """Pairs of different title word sets with a Jaccard similarity of 0.8 or more, between class representatives."""
    _, links = set_similarity(_title_sets(spark, d), 0.8)
    return links.select("class_a", "class_b", F.round("jaccard", 6).alias("jaccard"))


@query("F4 F5 U12", _SETS + """, k AS (SELECT class_a AS x, class_b AS y FROM l WHERE same >= 0.8 * (total - same) - 1e-9 UNION SELECT class_b, class_a FROM l WHERE same >= 0.8 * (total - same) - 1e-9),
r AS (SELECT DISTINCT x, x AS y FROM k UNION SELECT r.x, k.y FROM r JOIN k ON k.x = r.y), g AS (SELECT x, min(y) AS cluster FROM r GROUP BY x)
SELECT s.id, c.class_id, coalesce(g.cluster, c.class_id) AS cluster FROM s JOIN c ON c.items = s.items LEFT JOIN g ON g.x = c.class_id""")
def title_clusters(spark, d):
    """Class and cluster of every titled task: clusters are the components of the similarity links."""
    members, links = set_similarity(_title_sets(spark, d), 0.8)
    comp = components(links.select(F.col("class_a").alias("src"), F.col("class_b").alias("dst"))).select(F.col("node").alias("class_id"), "component")
    return members.join(comp, "class_id", "left").select("id", "class_id", F.coalesce("component", "class_id").alias("cluster"))


@query("M6 J23", "SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.6 AS is_exact FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4")
def near_vectors(spark, d):
    """Near duplicates of the stated query set (ids divisible by 20) among all vectors, in blocks."""
    e = V.vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    hits = block_search(e, e.where("id % 20 = 0"), 0.4)
    return hits.select("query_id", "id", (F.col("similarity") >= 0.6).alias("is_exact"))


@query("F6 F7 F13", P + """, t AS (SELECT kind, string_split(path, '/') AS parts FROM x_symbols WHERE path IS NOT NULL), x AS (SELECT kind, len(parts) AS length, parts, unnest(range(1, len(parts) + 1)) AS pos FROM t),
s AS (SELECT kind, length, pos, min(parts[pos]) AS low, max(parts[pos]) AS high, count(*) AS n FROM x GROUP BY kind, length, pos)
SELECT kind, length, string_agg(CASE WHEN low = high THEN low ELSE '?' END, ' ' ORDER BY pos) AS template, max(n) AS n_rows, count(*) FILTER (low <> high) AS n_holes FROM s GROUP BY kind, length""")
def path_templates(spark, d):
    """Least general template of the paths of each kind and length."""
    rows = V.symbols(spark, d).where("path IS NOT NULL").select("kind", F.split("path", "/").alias("parts"))
    return templates(rows, "kind", "parts").withColumn("length", F.col("length").cast("long"))


@query("F9 J22", _UNITS + """, g AS (SELECT fp3, kind, count(*) AS n FROM u WHERE fp3 IS NOT NULL GROUP BY fp3, kind)
SELECT b.id FROM u b WHERE start_line <= end_line AND NOT EXISTS (SELECT 1 FROM u o WHERE o.path = b.path AND o.id <> b.id AND o.start_line <= b.start_line AND b.end_line <= o.end_line AND o.mass > b.mass)""")
def undominated_units(spark, d):
    """Units that no longer unit of their file contains."""
    u = units(spark, d).where("start_line <= end_line")
    outer = u.select("path", F.col("id").alias("outer_id"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    inner = u.select("path", "id", F.col("start_line").alias("c"), F.col("end_line").alias("e"))
    inside = overlapping(outer, inner, "path", ("a", "b"), ("c", "e"), 200).where("a <= c AND e <= b AND b - a > e - c AND outer_id <> id")
    return u.select("id").join(inside.select("id"), "id", "left_anti")


_GROUPS = _UNITS + """, g AS (SELECT kind, facet, fp1, count(*) AS members, count(DISTINCT path) AS n_files, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS n_dirs, min(mass) AS mass, len(list_filter(string_split_regex(lower(regexp_replace(fp1, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_+'), lambda w: length(w) > 1)) AS anchors FROM u GROUP BY kind, facet, fp1),
m AS (SELECT *, mass + 3 * anchors AS evidence FROM g),
j AS (SELECT *, CASE WHEN evidence < 18 THEN 'G1.lowEvidence' WHEN mass < 8 THEN 'G1.lowMass' WHEN n_files < 2 THEN 'instances.singleFile'
  WHEN members = 2 AND NOT ((evidence >= 30 AND anchors >= 2) OR anchors >= 3 OR (kind = 'function' AND mass >= 20 AND anchors >= 1)) THEN 'instances.weakPair' END AS reason FROM m)"""


def _groups(spark, d):
    """Groups of equal names with their metrics and the first gate they fail (null: admitted)."""
    g = units(spark, d).groupBy("kind", "facet", "fp1").agg(
        F.count("*").alias("members"), F.count_distinct("path").alias("n_files"), F.count_distinct(F.regexp_replace("path", "/[^/]*$", "")).alias("n_dirs"), F.min("mass").alias("mass"))
    m = g.withColumn("anchors", F.size(X.subwords(F.col("fp1")))).withColumn("evidence", F.col("mass") + 3 * F.col("anchors"))
    strong = ((F.col("evidence") >= 30) & (F.col("anchors") >= 2)) | (F.col("anchors") >= 3) | ((F.col("kind") == "function") & (F.col("mass") >= 20) & (F.col("anchors") >= 1))
    reason = (
        F.when(F.col("evidence") < 18, "G1.lowEvidence").when(F.col("mass") < 8, "G1.lowMass").when(F.col("n_files") < 2, "instances.singleFile")
        .when((F.col("members") == 2) & ~strong, "instances.weakPair"))
    return m.withColumn("reason", reason)


@query("F10 F11 F12", _GROUPS + " SELECT kind, facet, fp1, members, mass, evidence, reason, members > 25 AND n_dirs > 10 AND evidence < 35 AS is_idiom FROM j WHERE members > 1")
def gated_groups(spark, d):
    idiom = (F.col("members") > 25) & (F.col("n_dirs") > 10) & (F.col("evidence") < 35)
    return _groups(spark, d).where("members > 1").select("kind", "facet", "fp1", "members", "mass", F.col("evidence").cast("long").alias("evidence"), "reason", idiom.alias("is_idiom"))


@query("F17 F18 F19 M17", _GROUPS + """, s AS (SELECT kind, facet, fp1, lower(replace(fp1, '_', '')) AS family, members * evidence AS score FROM j WHERE reason IS NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY kind, facet, family ORDER BY score DESC, fp1) AS r FROM s)
SELECT kind, facet, fp1, score, r > 1 AS is_folded, (SELECT max(fp1) FROM f h WHERE h.kind = f.kind AND h.facet = f.facet AND h.family = f.family AND h.r = 1) AS host FROM f""")
def ranked_groups(spark, d):
    """Admitted groups by score; a spelling variant folds into the best group of its family."""
    s = _groups(spark, d).where("reason IS NULL").select("kind", "facet", "fp1", F.lower(F.translate("fp1", "_", "")).alias("family"), (F.col("members") * F.col("evidence")).alias("score"))
    w = Window.partitionBy("kind", "facet", "family").orderBy(F.desc("score"), "fp1")
    return s.select("kind", "facet", "fp1", "score", (F.row_number().over(w) > 1).alias("is_folded"), F.first("fp1").over(w).alias("host"))


@query("F16", P + """, g AS (SELECT name, count(DISTINCT path) AS n FROM x_symbols WHERE name IS NOT NULL AND path IS NOT NULL GROUP BY name HAVING count(DISTINCT path) >= 3),
a AS (SELECT DISTINCT s.name, s.path, unnest(list_distinct(string_split(s.path, '/'))) AS part FROM x_symbols s JOIN g ON g.name = s.name WHERE s.path IS NOT NULL),
c AS (SELECT name, part, count(*) AS k FROM a GROUP BY name, part), m AS (SELECT c.name, c.part FROM c JOIN g ON g.name = c.name WHERE 3 * c.k >= 2 * g.n),
h AS (SELECT a.name, a.path, count(*) AS has FROM a JOIN m ON m.name = a.name AND m.part = a.part GROUP BY a.name, a.path), t AS (SELECT name, count(*) AS need FROM m GROUP BY name)
SELECT h.name, h.path, h.has, t.need FROM h JOIN t ON t.name = h.name WHERE h.has < t.need AND 3 * h.has >= 2 * t.need""")
def drifted_members(spark, d):
    """Members that have two thirds or more of their group's usual anchors, but not all."""
    s = V.symbols(spark, d).where("name IS NOT NULL AND path IS NOT NULL")
    g = s.groupBy("name").agg(F.count_distinct("path").alias("n")).where("n >= 3")
    a = s.join(g, "name", "left_semi").select("name", "path").distinct().select("name", "path", F.explode(F.array_distinct(F.split("path", "/"))).alias("part"))
    usual = a.groupBy("name", "part").agg(F.count("*").alias("k")).join(g, "name").where("3 * k >= 2 * n").select("name", "part")
    has = a.join(usual, ["name", "part"], "left_semi").groupBy("name", "path").agg(F.count("*").alias("has"))
    need = usual.groupBy("name").agg(F.count("*").alias("need"))
    return has.join(need, "name").where("has < need AND 3 * has >= 2 * need").select("name", "path", "has", "need")


@query("F20 R7 T14", P + """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'gone' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status
FROM (SELECT path, """ + SET_SQL.format("name") + """ AS h FROM x_symbols WHERE path IS NOT NULL AND name IS NOT NULL AND indexed_at < 1766000000000 GROUP BY path) a
FULL JOIN (SELECT path, """ + SET_SQL.format("name") + """ AS h FROM x_symbols WHERE path IS NOT NULL AND name IS NOT NULL GROUP BY path) b ON a.path = b.path""")
def dirty_files(spark, d):
    """Files whose fingerprint differs from an earlier snapshot: the set that an incremental run extracts again."""
    s = V.symbols(spark, d).where("path IS NOT NULL AND name IS NOT NULL")
    stamp = lambda f, n: f.groupBy("path").agg(set_digest(F.col("name")).alias(n))
    both = stamp(s.where("indexed_at < 1766000000000"), "a").join(stamp(s, "b"), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return both.select("path", status.alias("status"))


QUERIES = family.queries
