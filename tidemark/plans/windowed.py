"""Window-shaped queries: ranking, fusion, islands, sessions, trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import windows as W
from tidemark.operators.joins import first_of
from tidemark.operators.sessions import sweep_sessions
from tidemark.operators.evidence import global_rank
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.runtime import load

family = Family()
query = family.query
P = V.PRELUDE


@query("W2 M5", """SELECT label, vec_id, similarity FROM (SELECT label, vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS k FROM (
SELECT e.label, e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS similarity, row_number() OVER (PARTITION BY e.label ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS r
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7) WHERE r = 1) WHERE k <= 5""")
def best_per_target(spark, d, probe: int = 7):
    """The most similar vector of each target, the best five."""
    from tidemark.functions.hashing import dot

    e = V.vectors(spark, d)
    q = F.broadcast(e.where(F.col("vec_id") == probe).select(F.col("embedding").alias("q")).limit(1))  # a single row
    s = e.where(F.col("vec_id") != probe).crossJoin(q).select("label", "vec_id", dot(F.col("embedding"), F.col("q")).alias("exact"))
    best = first_of(s, ["label"], [F.desc("exact"), F.col("vec_id")])
    return best.select("label", "vec_id", F.round("exact", 4).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(5)


_LEX = """lex AS (SELECT path, row_number() OVER (ORDER BY n DESC, path) AS rank FROM (SELECT path, count(*) AS n FROM x_symbols WHERE path IS NOT NULL AND name ILIKE '%cache%' GROUP BY path)),
big AS (SELECT path, row_number() OVER (ORDER BY lines DESC, path) AS rank FROM x_files WHERE path ILIKE '%cache%')"""


@query("W3 X4", P + "," + _LEX + """ SELECT path, rank_1, rank_2, round(coalesce(1.0 / (60 + rank_1), 0) + coalesce(1.0 / (60 + rank_2), 0), 10) AS score
FROM (SELECT coalesce(a.path, b.path) AS path, a.rank AS rank_1, b.rank AS rank_2 FROM (SELECT * FROM lex WHERE rank <= 40) a FULL JOIN (SELECT * FROM big WHERE rank <= 40) b ON a.path = b.path) ORDER BY score DESC, path LIMIT 20""")
def rank_fusion(spark, d, limit: int = 20):
    """Reciprocal rank fusion of two rankings of files."""
    s = V.symbols(spark, d).where(F.col("path").isNotNull() & F.col("name").ilike("%cache%")).groupBy("path").agg(F.count("*").alias("n"))
    f = V.files(spark, d).where(F.col("path").ilike("%cache%"))
    # Each ranking is cut to its top first, so the window that numbers it sees few rows.
    one = s.orderBy(F.desc("n"), "path").limit(2 * limit).select("path", F.row_number().over(Window.orderBy(F.desc("n"), "path")).cast("long").alias("rank"))
    two = f.orderBy(F.desc("lines"), "path").limit(2 * limit).select("path", F.row_number().over(Window.orderBy(F.desc("lines"), "path")).cast("long").alias("rank"))
    fused = W.reciprocal_rank_fusion([one, two], "path").withColumn("score", F.round("score", 10))
    return fused.orderBy(F.desc("score"), "path").limit(limit)


@query("W6 T17", P + """SELECT author, arg_min(id, (moment, id)) AS first_id, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY author ORDER BY moment, id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, CASE WHEN moment - lag(moment) OVER (PARTITION BY author ORDER BY moment, id) < 120000 THEN 0 ELSE 1 END AS o FROM x_feed WHERE author IS NOT NULL AND moment IS NOT NULL)) GROUP BY author, s""")
def crash_sessions(spark, d):
    """Sessions of posts strictly less than two minutes apart, by the sweep, so a busy author is spread over hours."""
    f = V.feed(spark, d).select(F.col("author").alias("entity"), "at", F.col("id").alias("event_id"))
    return sweep_sessions(f, gap_ms=119_999).select(F.col("entity").alias("author"), "first_id", F.col("n_events").alias("n"))


@query("W7", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS q FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50) WHERE q <= 200")
def last_n_per_scope(spark, d):
    e = load(spark, d, "events")
    return W.last_n(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type")


@query("W8 S31 R47 R56", P + "SELECT id, moment AS \"at\" FROM x_feed WHERE moment IS NOT NULL ORDER BY moment DESC, id DESC LIMIT 50")
def latest_n_chronological(spark, d, n: int = 50):
    return V.feed(spark, d).where("at IS NOT NULL").orderBy(F.desc("at"), F.desc("id")).limit(n).select("id", "at").orderBy("at", "id")


@query("W9 W10", """WITH days AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, min(n) OVER () AS low, max(n) OVER () AS high FROM days)
SELECT strftime(day, '%Y-%m-%d') AS day, n, CASE WHEN high = low THEN 4 ELSE CAST(least(7, floor(8.0 * (n - low) / (high - low))) AS BIGINT) END AS tick FROM s""")
def sparkline(spark, d):
    """Daily counts as ticks of eight; a flat series stays in the middle. Extremes are joined as a single row."""
    days = load(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    ends = F.broadcast(days.agg(F.min("n").alias("low"), F.max("n").alias("high")))
    tick = F.when(F.col("high") == F.col("low"), 4).otherwise(F.least(F.lit(7), F.floor(8.0 * (F.col("n") - F.col("low")) / (F.col("high") - F.col("low")))))
    return days.crossJoin(ends).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", tick.alias("tick"))


@query("W9", P + "SELECT file_no % 10 AS scope, arg_max(line, (found_on, vid)) - arg_min(line, (found_on, vid)) AS delta FROM x_violations GROUP BY 1")
def trend_delta(spark, d):
    v = V.violations(spark, d)
    order = F.struct("found_on", "vid")
    return v.groupBy((F.col("file_no") % 10).alias("scope")).agg((F.max_by("line", order) - F.min_by("line", order)).alias("delta"))


@query("W11 W12 F2", """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS v, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)),
w AS (SELECT list(v) OVER (PARTITION BY l_orderkey, g ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS vs FROM r),
x AS (SELECT unnest(range(2, len(vs) + 1)) AS k, vs FROM w WHERE len(vs) >= 2)
SELECT CAST(k AS INTEGER) AS k, array_to_string(vs[1:k], ',') AS window_key, count(*) AS n FROM x GROUP BY 1, 2""")
def k_row_windows(spark, d):
    """How often each sequence of two to six consecutive flags occurs within an order (the least flag of a line number)."""
    rows = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("v"))
    return W.k_windows(rows, ["l_orderkey"], "l_linenumber", "v", 2, 6).groupBy(F.col("window_size").alias("k"), "window_key").agg(F.count("*").alias("n"))


@query("W15", P + "SELECT id, CASE WHEN state <> 'duplicate' THEN row_number() OVER (PARTITION BY tier, state = 'duplicate' ORDER BY total_tokens DESC, id) END AS place FROM x_tasks WHERE total_tokens IS NOT NULL AND tier IS NOT NULL")
def rank_unfolded(spark, d):
    """Places of tasks in their tier; folded ones (duplicates) get none."""
    t = V.tasks(spark, d).where("total_tokens IS NOT NULL AND tier IS NOT NULL")
    folded = F.col("state") == "duplicate"
    ranked = global_rank(t.where(~folded).select("id", "tier", "total_tokens"), ["tier"], [F.desc("total_tokens"), F.col("id")], "place")
    return ranked.select("id", "place").unionByName(t.where(folded).select("id", F.lit(None).cast("long").alias("place")))


@query("W16 W17 T16", P + """SELECT t.id, arg_max(f.event_type, (f.moment, f.id)) AS light, coalesce(max(f.moment) > any_value(t.updated_at), false) AS is_newer FROM x_tasks t LEFT JOIN x_feed f ON f.task_id = t.id AND f.moment IS NOT NULL GROUP BY t.id""")
def current_light(spark, d):
    """Latest event of each task, and whether it came after the task's last change."""
    f = V.feed(spark, d).where("at IS NOT NULL AND task_id IS NOT NULL").groupBy(F.col("task_id").alias("id")).agg(F.max_by("event_type", F.struct("at", "id")).alias("light"), F.max("at").alias("last"))
    t = V.tasks(spark, d).select("id", "updated_at").join(f, "id", "left")
    return t.select("id", "light", F.coalesce(F.col("last") > F.col("updated_at"), F.lit(False)).alias("is_newer"))


@query("W18", P + """SELECT doc_id, line, is_hit FROM (SELECT *, max(is_hit) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM (SELECT doc_id, line, contains(text, 'return null') AS is_hit FROM x_lines)) WHERE near""")
def context_lines(spark, d):
    """Matching lines with one line before and two after."""
    return W.context_rows(V.lines(spark, d), ["doc_id"], "line", F.col("text").contains("return null"), 1, 2).select("doc_id", "line", "is_hit")


@query("W19", P + """SELECT thread_id, id FROM (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY id DESC) AS r FROM x_feed WHERE thread_id IS NOT NULL) WHERE r <= 6""")
def post_context(spark, d):
    """The last post of each thread with its five predecessors."""
    return W.last_n(V.feed(spark, d).where("thread_id IS NOT NULL"), ["thread_id"], [F.desc("id")], 6).select("thread_id", "id")


@query("A51", """WITH w AS (SELECT DISTINCT doc_kind, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_kind, count(DISTINCT doc_id) AS total FROM documents WHERE text IS NOT NULL GROUP BY doc_kind)
SELECT w.doc_kind, word, count(*) AS n FROM w JOIN n ON n.doc_kind = w.doc_kind GROUP BY w.doc_kind, word, total HAVING count(*) > 0.4 * total""")
def ubiquitous_words(spark, d):
    """Words in more than two fifths of a kind's documents."""
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_kind", "doc_id", "text")
    words = docs.select("doc_kind", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("word"))
    total = F.broadcast(docs.groupBy("doc_kind").agg(F.count_distinct("doc_id").alias("total")))  # one row per kind of document
    return words.groupBy("doc_kind", "word").agg(F.count("*").alias("n")).join(total, "doc_kind").where("n > 0.4 * total").select("doc_kind", "word", "n")


@query("A52 A53", P + """, g AS (SELECT name, list(DISTINCT path) AS paths, count(*) AS members, min(end_line - start_line) AS mass FROM x_symbols WHERE name IS NOT NULL AND path IS NOT NULL GROUP BY name HAVING count(DISTINCT path) >= 2),
p AS (SELECT name, unnest(paths) AS path FROM g), a AS (SELECT name, part, count(*) AS n FROM (SELECT DISTINCT name, path, unnest(string_split(path, '/')) AS part FROM p) GROUP BY name, part)
SELECT g.name, g.members, g.mass, (SELECT count(*) FROM a WHERE a.name = g.name AND a.n = len(g.paths)) AS n_shared, g.mass + 3 * (SELECT count(*) FROM a WHERE a.name = g.name AND a.n = len(g.paths)) AS evidence FROM g""")
def shared_parts(spark, d):
    """Path parts that all files of a name share, with the group's mass and evidence. Shared means counted in every file, so no set is collected."""
    s = V.symbols(spark, d).where("name IS NOT NULL AND path IS NOT NULL")
    g = s.groupBy("name").agg(F.count_distinct("path").alias("n_files"), F.count("*").alias("members"), F.min(F.col("end_line") - F.col("start_line")).alias("mass")).where("n_files >= 2")
    parts = s.select("name", "path").distinct().select("name", F.explode(F.array_distinct(F.split("path", "/"))).alias("part")).groupBy("name", "part").agg(F.count("*").alias("n"))
    shared = parts.join(g.select("name", "n_files"), "name").where("n = n_files").groupBy("name").agg(F.count("*").alias("n_shared"))
    out = g.join(shared, "name", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return out.select("name", "members", "mass", "n_shared", (F.col("mass") + 3 * F.col("n_shared")).alias("evidence"))


@query("X1 X2", P + """SELECT id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[-_./\\\\]+', ' ', 'g')), '\\s+'), lambda w: length(w) > 1), ' ') AS words FROM x_symbols WHERE name IS NOT NULL""")
def identifier_words(spark, d):
    return V.symbols(spark, d).where("name IS NOT NULL").select("id", F.array_join(X.subwords(F.col("name")), " ").alias("words"))


QUERIES = family.queries
