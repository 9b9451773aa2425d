"""Aggregations: counts, roll-ups, scores, medians, accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.operators import scores as S
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.runtime import load

family = Family()
query = family.query
P = V.PRELUDE


@query("A1", P + "SELECT name, count(*) AS n, count(DISTINCT path) AS n_files FROM x_symbols WHERE name IS NOT NULL GROUP BY name")
def occurrences(spark, d):
    return V.symbols(spark, d).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))


@query("A2 A9 R19 R58 S29", P + """SELECT 'files' AS name, count(*) AS n FROM x_files UNION ALL SELECT 'symbols', count(*) FROM x_symbols UNION ALL SELECT 'exports', count(*) FROM x_symbols WHERE is_export = 1
UNION ALL SELECT 'tasks', count(*) FROM x_tasks UNION ALL SELECT 'posts', count(*) FROM x_feed UNION ALL SELECT 'calls', count(*) FROM x_calls""")
def index_stats(spark, d):
    frames = {
        "files": V.files(spark, d), "symbols": V.symbols(spark, d), "exports": V.symbols(spark, d).where("is_export = 1"),
        "tasks": V.tasks(spark, d), "posts": V.feed(spark, d), "calls": V.calls(spark, d),
    }
    return reduce(DataFrame.union, [f.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, f in frames.items()]).select("name", "n")


@query("A3 A7", P + "SELECT coalesce(nullif(tier, ''), 'unlabelled') AS label, n, chars FROM (SELECT tier, count(*) AS n, sum(chars)::BIGINT AS chars FROM x_files GROUP BY tier)")
def tier_histogram(spark, d):
    per = V.files(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return per.select(F.coalesce(F.when(F.col("tier") != "", F.col("tier")), F.lit("unlabelled")).alias("label"), "n", "chars")


@query("A5 P14", P + """SELECT count(*) AS n_tasks, count(telemetry_source) AS n_measured, count(*) - count(telemetry_source) AS n_unmeasured,
coalesce(sum(total_tokens) FILTER (telemetry_source IS NOT NULL), 0)::BIGINT AS tokens FROM x_tasks""")
def token_breakdown(spark, d):
    known = F.col("telemetry_source").isNotNull()
    return V.tasks(spark, d).agg(
        F.count("*").alias("n_tasks"), F.count("telemetry_source").alias("n_measured"), (F.count("*") - F.count("telemetry_source")).alias("n_unmeasured"),
        F.coalesce(F.sum(F.when(known, F.col("total_tokens"))), F.lit(0)).alias("tokens"),
    )


@query("A6 A21", P + """SELECT who, sum(total_tokens)::BIGINT AS tokens, sum(micros) / 1e6 AS cost FROM x_usage WHERE who IS NOT NULL AND total_tokens > 0 GROUP BY who ORDER BY tokens DESC, who LIMIT 10""")
def top_agents(spark, d):
    u = V.usage(spark, d).where("who IS NOT NULL AND total_tokens > 0").groupBy("who").agg(F.sum("total_tokens").alias("tokens"), (F.sum("micros") / 1e6).alias("cost"))
    return u.orderBy(F.desc("tokens"), "who").limit(10)


@query("A8 A41", P + """SELECT priority, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'in_progress') AS in_progress, count(*) FILTER (state = 'blocked') AS blocked,
count(*) FILTER (state = 'done') AS done FROM x_tasks GROUP BY priority""")
def status_pivot(spark, d):
    p = V.tasks(spark, d).groupBy("priority").pivot("state", ["queued", "in_progress", "blocked", "done"]).count()
    return p.fillna(0)


@query("A10", P + """SELECT sum(CASE WHEN valid = 1 THEN 1 ELSE 0 END)::BIGINT AS n_valid, count(*) AS n, round(100.0 * sum(CASE WHEN valid = 1 THEN 1 ELSE 0 END) / nullif(count(*), 0), 2) AS percent,
round(sum(CASE WHEN valid = 1 THEN 1 ELSE 0 END) / greatest(sum(attempts) / 1000.0, 0.001), 3) AS per_thousand FROM x_fills""")
def fill_precision(spark, d):
    good = F.sum(F.when(F.col("valid") == 1, 1).otherwise(0))
    return V.fills(spark, d).agg(
        good.alias("n_valid"), F.count("*").alias("n"), F.round(100.0 * good / F.nullif(F.count("*"), F.lit(0)), 2).alias("percent"),
        F.round(good / F.greatest(F.sum("attempts") / 1000.0, F.lit(0.001)), 3).alias("per_thousand"),
    )


@query("A12 A14", P + """SELECT file_path, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, max(line) AS last_line, coalesce(min(line) FILTER (severity = 'CRITICAL'), 0) AS first_critical FROM x_violations GROUP BY file_path""")
def rules_per_file(spark, d):
    v = V.violations(spark, d).groupBy("file_path")
    return v.agg(
        F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.max("line").alias("last_line"),
        F.coalesce(F.min(F.when(F.col("severity") == "CRITICAL", F.col("line"))), F.lit(0)).alias("first_critical"),
    )


@query("A15 A16 R53", P + """SELECT task_id, sum(input_tokens)::BIGINT AS input, sum(output_tokens)::BIGINT AS output, sum(cache_read_tokens)::BIGINT AS cache_read, sum(total_tokens)::BIGINT AS total, sum(calls)::BIGINT AS calls, sum(micros) / 1e6 AS cost
FROM x_usage WHERE task_id IS NOT NULL GROUP BY task_id""")
def usage_by_task(spark, d):
    s = lambda c, n: F.sum(c).alias(n)
    return V.usage(spark, d).where("task_id IS NOT NULL").groupBy("task_id").agg(
        s("input_tokens", "input"), s("output_tokens", "output"), s("cache_read_tokens", "cache_read"), s("total_tokens", "total"), s("calls", "calls"), (F.sum("micros") / 1e6).alias("cost"))


@query("A17 A45", P + """SELECT who, model, grouping(who, model) AS level, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM x_usage GROUP BY GROUPING SETS ((who), (model), ())""")
def rollup_by_handle_and_model(spark, d):
    u = V.usage(spark, d)
    sets = [[F.col("who")], [F.col("model")], []]
    return u.groupingSets(sets, "who", "model").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")).select("who", "model", "level", "n", "tokens")


@query("A18 T18", """SELECT verb, sum(chars)::BIGINT AS chars, count(*) AS n FROM (SELECT id, lower(trim(min(action))) AS verb, max(result_chars) AS chars FROM tool_calls GROUP BY id) GROUP BY verb""")
def max_then_sum(spark, d):
    """Repeated entries of one message: the field-wise maximum per id first, then sums."""
    one = load(spark, d, "tool_calls").groupBy("id").agg(F.lower(F.trim(F.min("action"))).alias("verb"), F.max("result_chars").alias("chars"))
    return one.groupBy("verb").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))


@query("A19", P + "SELECT who, arg_max(model, (n, model)) AS model FROM (SELECT who, model, sum(calls) AS n FROM x_usage WHERE who IS NOT NULL AND model IS NOT NULL GROUP BY who, model) GROUP BY who")
def primary_model(spark, d):
    n = V.usage(spark, d).where("who IS NOT NULL AND model IS NOT NULL").groupBy("who", "model").agg(F.sum("calls").alias("n"))
    return n.groupBy("who").agg(F.max_by("model", F.struct("n", "model")).alias("model"))


_ACCOUNT = """count(*) AS n_calls, count(*) FILTER (m) AS n_measured, CAST(ceil(sum(result_chars) / 4.0) AS BIGINT) AS overhead_tokens,
CAST(ceil(coalesce(sum(cf_chars) FILTER (m), 0) / 4.0) - ceil(coalesce(sum(result_chars) FILTER (m), 0) / 4.0) AS BIGINT) AS gross_saved, CAST(ceil((sum(result_chars) - coalesce(sum(result_chars) FILTER (m), 0)) / 4.0) AS BIGINT) AS unmeasured_tokens,
CAST(ceil(coalesce(sum(cf_chars) FILTER (m), 0) / 4.0) - ceil(coalesce(sum(result_chars) FILTER (m), 0) / 4.0) - ceil((sum(result_chars) - coalesce(sum(result_chars) FILTER (m), 0)) / 4.0) AS BIGINT) AS net_saved,
coalesce(sum(cf_calls) FILTER (cf_kind = 'validation-call'), 0)::BIGINT AS avoided, count(*) FILTER (m) BETWEEN 1 AND 4 AS is_thin FROM (SELECT *, coalesce(cf_kind IN ('file-whole', 'raw-output'), false) AS m FROM x_calls)"""


@query("A20 M13", P + "SELECT verb, " + _ACCOUNT + " WHERE verb IS NOT NULL GROUP BY verb")
def counterfactual_ledger(spark, d):
    return S.account_calls(V.calls(spark, d).where("verb IS NOT NULL"), ["verb"])


@query("A20 A21", P + "SELECT " + _ACCOUNT)
def counterfactual_totals(spark, d):
    """Totals come from summed characters, as the ceiling of a sum is not the sum of ceilings."""
    return S.account_calls(V.calls(spark, d), [])


@query("A22 R9", P + """SELECT c.id, coalesce(c.handle, s.who) AS handle FROM x_calls c LEFT JOIN (SELECT session, min(handle) AS who FROM x_calls WHERE session IS NOT NULL AND handle IS NOT NULL GROUP BY session HAVING count(DISTINCT handle) = 1) s ON s.session = c.session""")
def reattribute_unique(spark, d):
    """Calls without an agent get the only agent of their session."""
    c = V.calls(spark, d)
    lone = c.where("session IS NOT NULL AND handle IS NOT NULL").groupBy("session").agg(F.min("handle").alias("who"), F.max("handle").alias("most")).where("who = most")
    return c.join(lone.select("session", "who"), "session", "left").select("id", F.coalesce("handle", "who").alias("handle"))


@query("A23 A25 D6", P + """SELECT priority, count(*) AS n_tasks, count(telemetry_source) AS n_measured, median(total_tokens) FILTER (telemetry_source IS NOT NULL) AS median_tokens,
median(updated_at - created_at) FILTER (telemetry_source IS NOT NULL) AS median_wall_ms FROM x_tasks WHERE state = 'done' GROUP BY priority""")
def points_curve(spark, d):
    known = F.col("telemetry_source").isNotNull()
    return V.tasks(spark, d).where("state = 'done'").groupBy("priority").agg(
        F.count("*").alias("n_tasks"), F.count("telemetry_source").alias("n_measured"), F.median(F.when(known, F.col("total_tokens"))).alias("median_tokens"),
        F.median(F.when(known, F.col("updated_at") - F.col("created_at"))).alias("median_wall_ms"))


@query("A24", P + """SELECT count(*) AS n_tasks, coalesce(sum(priority), 0)::BIGINT AS points, round(coalesce(sum(priority), 0) / 14.0 * 7, 1) AS per_week FROM x_tasks
WHERE state = 'done' AND updated_at >= (SELECT max(updated_at) FROM x_tasks) - 14 * 86400000""")
def velocity(spark, d, days: int = 14):
    t = V.tasks(spark, d)
    now = F.broadcast(t.agg(F.max("updated_at").alias("now")))  # a single row
    done = t.where("state = 'done'").join(now, F.col("updated_at") >= F.col("now") - days * 86_400_000)
    points = F.coalesce(F.sum("priority"), F.lit(0))
    return done.agg(F.count("*").alias("n_tasks"), points.alias("points"), F.round(points / float(days) * 7, 1).alias("per_week"))


_FIB = [1, 2, 3, 5, 8, 13, 21]


@query("A26 A27", """SELECT l_orderkey, round(avg(p), 2) AS average, coalesce(list_extract(list_filter([1,2,3,5,8,13,21], lambda x: x >= avg(p)), 1), 21) AS estimate,
list_position([1,2,3,5,8,13,21], max(p)) - list_position([1,2,3,5,8,13,21], min(p)) > 1 AS is_outlier
FROM (SELECT l_orderkey, ([1,2,3,5,8,13,21])[CAST(l_quantity AS INTEGER) % 7 + 1] AS p FROM lineitem) GROUP BY l_orderkey""")
def vote_settle(spark, d):
    """Average vote, the next interval at or above it, and whether votes lie more than one step apart."""
    fib = F.array(*map(F.lit, _FIB))
    v = load(spark, d, "lineitem").select("l_orderkey", F.element_at(fib, F.col("l_quantity").cast("int") % 7 + 1).alias("p"))
    g = v.groupBy("l_orderkey").agg(F.avg("p").alias("a"), F.max("p").alias("high"), F.min("p").alias("low"))
    up = F.coalesce(F.get(F.filter(fib, lambda x: x >= F.col("a")), F.lit(0)), F.lit(21))
    return g.select("l_orderkey", F.round("a", 2).alias("average"), up.alias("estimate"), (F.array_position(fib, F.col("high")) - F.array_position(fib, F.col("low")) > 1).alias("is_outlier"))


_GRADE = "CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade"


@query("A28 M16", f"""WITH v AS (SELECT c_nationkey, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 2 ELSE 1 END) AS w FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey),
f AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey),
s AS (SELECT f.c_nationkey, n AS n_files, CAST(greatest(0, least(100, floor(100 - 1.5 * (coalesce(w, 0) / greatest(1, n)) + 0.5))) AS BIGINT) AS score FROM f LEFT JOIN v ON v.c_nationkey = f.c_nationkey)
SELECT c_nationkey, n_files, score, {_GRADE} FROM s""")
def health_by_group(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    v = V.violations(spark, d).join(c, F.col("file_no") == F.col("c_custkey")).select("c_nationkey", "severity")
    return S.health(v, c, ["c_nationkey"]).select("c_nationkey", "n_files", "score", "grade")


@query("A29", P + """SELECT p.pillar, coalesce(n, 0) AS n, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
CASE WHEN critical > 0 THEN 'FAILED' WHEN high > 0 OR medium > 1 THEN 'WARN' ELSE 'PASSED' END AS status FROM (SELECT 'PILLAR_' || unnest(range(1, 13)) AS pillar) p
LEFT JOIN (SELECT pillar, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low
FROM x_violations WHERE rule <> 'RULE_5' GROUP BY pillar) c ON c.pillar = p.pillar""")
def pillar_breakdown(spark, d):
    pillars = spark.range(1, 13).select(F.concat(F.lit("PILLAR_"), "id").alias("pillar"))
    return S.pillar_status(V.violations(spark, d).where("rule <> 'RULE_5'"), pillars)


@query("A30", P + f"""SELECT n, score, {_GRADE} FROM (SELECT count(*) AS n, CAST(greatest(0, least(100, floor(100 - 1.5 * (sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 2 ELSE 1 END) / greatest(1, (SELECT count(*) FROM customer))) + 0.5))) AS BIGINT) AS score
FROM x_violations WHERE rule = 'RULE_5')""")
def slop_score(spark, d):
    files = F.broadcast(load(spark, d, "customer").agg(F.count("*").alias("files")))  # a single row
    v = V.violations(spark, d).where("rule = 'RULE_5'").agg(F.count("*").alias("n"), F.sum(S.severity_weight(F.col("severity"), S.SLOP_WEIGHTS)).alias("w"))
    score = S.density_score(F.col("w") / F.greatest(F.lit(1), "files"))
    return v.crossJoin(files).select("n", score.alias("score")).withColumn("grade", S.grade(F.col("score")))


@query("A31 M13", P + """SELECT CAST(floor(sum(chars) / 3.8 + 0.5) AS BIGINT) AS tokens, CAST(floor(sum(greatest(chars - 36 * budget, 0)) / 3.8 + 0.5) AS BIGINT) AS excess_tokens,
CAST(least(85, floor(sum(greatest(chars - 36 * budget, 0)) / sum(chars) * 100 + 0.5)) AS BIGINT) AS percent FROM (SELECT chars, CASE WHEN tier = 'molecule' THEN 50 ELSE 100 END AS budget FROM x_files)""")
def token_burn(spark, d):
    budget = F.when(F.col("tier") == "molecule", 50).otherwise(100)
    f = V.files(spark, d).select("chars", F.greatest(F.col("chars") - S.CHARS_PER_LINE * budget, F.lit(0)).alias("excess"))
    r = N.js_round
    return f.agg(r(F.sum("chars") / S.CHARS_PER_TOKEN).alias("tokens"), r(F.sum("excess") / S.CHARS_PER_TOKEN).alias("excess_tokens"), F.least(F.lit(85), r(F.sum("excess") / F.sum("chars") * 100)).alias("percent"))


@query("A32 A34 X28", P + """SELECT s.path, s.n, coalesce(f.lines, 0) AS n_lines, CASE WHEN f.lines >= 2000 THEN 'extreme' WHEN f.lines >= 1000 THEN 'severe' WHEN f.lines > 500 THEN 'warning' END AS size_class
FROM (SELECT path, count(*) AS n FROM x_symbols WHERE path IS NOT NULL GROUP BY path) s LEFT JOIN x_files f ON f.path = s.path ORDER BY s.n DESC, n_lines DESC, s.path LIMIT 5""")
def top_hotspots(spark, d, limit: int = 5):
    s = V.symbols(spark, d).where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"))
    size = F.when(F.col("lines") >= 2000, "extreme").when(F.col("lines") >= 1000, "severe").when(F.col("lines") > 500, "warning")
    out = s.join(V.files(spark, d).select("path", "lines"), "path", "left").select("path", "n", F.coalesce("lines", F.lit(0)).alias("n_lines"), size.alias("size_class"))
    return out.orderBy(F.desc("n"), F.desc("n_lines"), "path").limit(limit)


@query("A33", P + """SELECT count(*) AS n_files, sum(lines)::BIGINT AS n_lines, round(avg(lines), 2) AS mean_lines, arg_max(path, (lines, path)) AS largest, round(100.0 * count(*) FILTER (lines <= 100) / count(*), 1) AS compliant_pct FROM x_files""")
def file_metrics(spark, d):
    return V.files(spark, d).agg(
        F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"), F.round(F.avg("lines"), 2).alias("mean_lines"),
        F.max_by("path", F.struct("lines", "path")).alias("largest"), F.round(100.0 * F.count_if(F.col("lines") <= 100) / F.count("*"), 1).alias("compliant_pct"))


@query("A34", P + "SELECT regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS ext, count(*) AS n, sum(lines)::BIGINT AS n_lines FROM x_files GROUP BY 1")
def count_by_extension(spark, d):
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("ext")
    return V.files(spark, d).groupBy(ext).agg(F.count("*").alias("n"), F.sum("lines").alias("n_lines"))


@query("A37", P + "SELECT split_part(file_path, '/', 2) AS scope, rule, count(*) AS n FROM x_violations GROUP BY ALL")
def ratchet_baseline(spark, d):
    return V.violations(spark, d).groupBy(F.split_part("file_path", F.lit("/"), F.lit(2)).alias("scope"), "rule").agg(F.count("*").alias("n"))


@query("A38", "SELECT doc_kind, count(*) AS n, count(*) FILTER (text IS NOT NULL AND n_chars > 0) AS n_read, count(*) FILTER (text IS NULL OR n_chars = 0) AS n_skipped FROM documents GROUP BY doc_kind")
def coverage_summary(spark, d):
    read = F.col("text").isNotNull() & (F.col("n_chars") > 0)
    return load(spark, d, "documents").groupBy("doc_kind").agg(F.count("*").alias("n"), F.count_if(read).alias("n_read"), F.count_if(F.col("text").isNull() | (F.col("n_chars") == 0)).alias("n_skipped"))


@query("A39 A40", P + "SELECT state, origin_type, count(*) AS n FROM x_tasks GROUP BY state, origin_type")
def status_pairs(spark, d):
    return V.tasks(spark, d).groupBy("state", "origin_type").agg(F.count("*").alias("n"))


@query("A43", P + """SELECT 'posts' AS metric, count(*)::DOUBLE AS value FROM x_feed UNION ALL SELECT 'threads', count(DISTINCT thread_id) FROM x_feed UNION ALL SELECT 'authors', count(DISTINCT author) FROM x_feed
UNION ALL SELECT 'unread', count(*) FROM x_feed WHERE recipient_id IS NOT NULL AND read_at IS NULL UNION ALL SELECT 'mean_length', round(avg(length(message)), 3) FROM x_feed""")
def forum_metrics(spark, d):
    f = V.feed(spark, d)
    row = f.agg(
        F.count("*").cast("double").alias("posts"), F.count_distinct("thread_id").cast("double").alias("threads"), F.count_distinct("author").cast("double").alias("authors"),
        F.count_if(F.col("recipient_id").isNotNull() & F.col("read_at").isNull()).cast("double").alias("unread"), F.round(F.avg(F.length("message")), 3).alias("mean_length"))
    return row.unpivot([], row.columns, "metric", "value")


@query("A44 R35", P + """SELECT peer, count(*) AS n, count(*) FILTER (unread) AS n_unread, arg_max(id, (coalesce(moment, 0), id)) AS last_id FROM (
SELECT id, moment, CASE WHEN author = 'silver-wren' THEN them ELSE author END AS peer, them = 'silver-wren' AND read_at IS NULL AS unread FROM (SELECT *, """ + N.sql_handle("recipient_id") + """ AS them FROM x_feed)
WHERE them IS NOT NULL AND (author = 'silver-wren' OR them = 'silver-wren')) GROUP BY peer""")
def direct_conversations(spark, d, me: str = "silver-wren"):
    f = V.feed(spark, d).withColumn("them", N.handle_key(F.col("recipient_id"))).where(F.col("them").isNotNull() & ((F.col("author") == me) | (F.col("them") == me)))
    peer = F.when(F.col("author") == me, F.col("them")).otherwise(F.col("author"))
    return f.groupBy(peer.alias("peer")).agg(F.count("*").alias("n"), F.count_if((F.col("them") == me) & F.col("read_at").isNull()).alias("n_unread"), F.max_by("id", F.struct(F.coalesce("at", F.lit(0)), "id")).alias("last_id"))


@query("A45 A46", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) // 25 AS band, grouping(event_type, band) AS level, count(*) AS n FROM (SELECT event_type, props, CAST(json_extract_string(props, '$.k') AS INTEGER) // 25 AS band FROM events) GROUP BY GROUPING SETS ((event_type), (band), ())".replace("CAST(json_extract_string(props, '$.k') AS INTEGER) // 25 AS band, grouping", "band, grouping", 1))
def friction_summary(spark, d):
    e = load(spark, d, "events").select("event_type", F.expr("CAST(get_json_object(props, '$.k') AS INT) DIV 25").cast("int").alias("band"))
    return e.groupingSets([[F.col("event_type")], [F.col("band")], []], "event_type", "band").agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select("event_type", "band", "level", "n")


@query("A47", P + """, today AS (SELECT * FROM x_feed WHERE moment >= 1774915200000 AND coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.archived') END, '0') <> '1')
SELECT author, count(*) AS n, count(*) FILTER (event_type = 'commit') AS n_commits, count(*) FILTER (event_type = 'handoff') AS n_handoffs FROM today WHERE NOT starts_with(event_type, 'lock_') AND author IS NOT NULL GROUP BY author ORDER BY n DESC, author LIMIT 5""")
def digest_since(spark, d, since: int = 1_774_915_200_000):
    """Busiest authors since a day's start, without lock noise and archived rows."""
    open_ = F.coalesce(F.get_json_object("metadata", "$.archived"), F.lit("0")) != "1"
    f = V.feed(spark, d).where((F.col("at") >= since) & open_ & ~F.col("event_type").startswith("lock_") & F.col("author").isNotNull())
    n = lambda t: F.count_if(F.col("event_type") == t)
    return f.groupBy("author").agg(F.count("*").alias("n"), n("commit").alias("n_commits"), n("handoff").alias("n_handoffs")).orderBy(F.desc("n"), "author").limit(5)


@query("A48", P + "SELECT author, event_type, count(*) AS n FROM x_feed WHERE author IS NOT NULL GROUP BY author, event_type")
def types_by_author(spark, d):
    return V.feed(spark, d).where("author IS NOT NULL").groupBy("author", "event_type").agg(F.count("*").alias("n"))


@query("A49 D7", P + """SELECT t.id, CAST(floor((1775000000000 - max(f.moment)) / 3600000.0) AS BIGINT) AS idle_hours FROM x_tasks t JOIN x_feed f ON f.author = t.handle WHERE t.state = 'in_progress' GROUP BY t.id HAVING 1775000000000 - max(f.moment) >= 6 * 3600000""")
def idle_claims(spark, d, now: int = 1_775_000_000_000):
    """Claimed tasks whose agent has been silent for six hours or more."""
    last = V.feed(spark, d).where("author IS NOT NULL").groupBy(F.col("author").alias("handle")).agg(F.max("at").alias("last"))
    idle = F.lit(now) - F.col("last")
    t = V.tasks(spark, d).where("state = 'in_progress'").join(last, "handle").where(idle >= 6 * 3_600_000)
    return t.select("id", F.floor(idle / 3_600_000).alias("idle_hours"))


@query("A50", P + "SELECT count(*) AS n, min(id) AS low, max(id) AS high, sum(id)::BIGINT AS total FROM x_symbols")
def change_fingerprint(spark, d):
    return V.symbols(spark, d).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum("id").alias("total"))


@query("A55", P + """SELECT kind, signature, n_files, n, is_hot, n * n_files * CASE WHEN is_hot THEN 2 ELSE 1 END AS impact FROM (SELECT s.kind, s.signature, count(DISTINCT s.path) AS n_files, count(*) AS n, max(coalesce(f.hazard_count, 0)) > 0 AS is_hot
FROM (SELECT kind, path, CASE WHEN name LIKE '%\\_%' ESCAPE '\\' THEN split_part(lower(name), '_', 1) ELSE regexp_extract(name, '^[A-Za-z][a-z]*') END AS signature FROM x_symbols WHERE path IS NOT NULL AND name IS NOT NULL) s LEFT JOIN x_files f ON f.path = s.path GROUP BY s.kind, s.signature HAVING count(DISTINCT s.path) >= 3)
ORDER BY impact DESC, kind, signature LIMIT 12""")
def pattern_candidates(spark, d):
    """Shapes that recur in three files or more, those on files with hazards counted twice."""
    shape = F.when(F.col("name").contains("_"), F.split_part(F.lower("name"), F.lit("_"), F.lit(1))).otherwise(F.regexp_extract("name", "^[A-Za-z][a-z]*", 0))
    s = V.symbols(spark, d).where("path IS NOT NULL AND name IS NOT NULL").select("kind", "path", shape.alias("signature"))
    g = s.join(V.files(spark, d).select("path", "hazard_count"), "path", "left").groupBy("kind", "signature").agg(
        F.count_distinct("path").alias("n_files"), F.count("*").alias("n"), (F.max(F.coalesce("hazard_count", F.lit(0))) > 0).alias("is_hot"))
    out = g.where("n_files >= 3").withColumn("impact", F.col("n") * F.col("n_files") * F.when(F.col("is_hot"), 2).otherwise(1))
    return out.orderBy(F.desc("impact"), "kind", "signature").limit(12)


@query("A56", P + """SELECT cluster, count(DISTINCT name) AS n_spellings FROM (SELECT name, lower(replace(name, '_', '')) AS cluster FROM x_symbols WHERE name IS NOT NULL) GROUP BY cluster HAVING count(DISTINCT name) > 1""")
def naming_consistency(spark, d):
    s = V.symbols(spark, d).where("name IS NOT NULL").select("name", F.lower(F.translate("name", "_", "")).alias("cluster"))
    return s.groupBy("cluster").agg(F.count_distinct("name").alias("n_spellings")).where("n_spellings > 1")


@query("A57", P + """SELECT group_id, (['none','fill','review'])[max(list_position(['none','fill','review'], needs))] AS needs FROM x_blueprints WHERE needs IS NOT NULL GROUP BY group_id""")
def max_needs(spark, d):
    order = F.array(F.lit("none"), F.lit("fill"), F.lit("review"))
    top = V.blueprints(spark, d).where("needs IS NOT NULL").groupBy("group_id").agg(F.max(F.array_position(order, F.col("needs"))).alias("k"))
    return top.select("group_id", F.element_at(order, F.col("k").cast("int")).alias("needs"))


@query("A58", P + "SELECT coalesce(max(updated_seq), 0) + 1 AS next_seq FROM x_blueprints")
def next_sequence(spark, d):
    return V.blueprints(spark, d).agg((F.coalesce(F.max("updated_seq"), F.lit(0)) + 1).alias("next_seq"))


@query("R14 A9", P + "SELECT max(synced_at) AS latest, count(*) FILTER (mtime > (SELECT min(synced_at) FROM x_files)) AS n_newer FROM x_files")
def audit_freshness(spark, d):
    f = V.files(spark, d)
    low = F.broadcast(f.agg(F.min("synced_at").alias("low")))  # a single row
    return f.crossJoin(low).agg(F.max("synced_at").alias("latest"), F.count_if(F.col("mtime") > F.col("low")).alias("n_newer"))


@query("R38 R39 R17", P + "SELECT id FROM x_agents a WHERE state <> 'deleted' AND NOT EXISTS (SELECT 1 FROM x_tasks t WHERE t.handle = a.handle AND t.state = 'in_progress')")
def free_agents(spark, d):
    busy = V.tasks(spark, d).where("state = 'in_progress'").select("handle")
    return V.agents(spark, d).where("state <> 'deleted'").join(busy, "handle", "left_anti").select("id")


@query("R4 R18", P + "SELECT handle, arg_max(id, (updated_at, id)) AS task FROM x_tasks WHERE state = 'in_progress' AND handle IS NOT NULL GROUP BY handle")
def claimed_task(spark, d):
    t = V.tasks(spark, d).where("state = 'in_progress' AND handle IS NOT NULL")
    return t.groupBy("handle").agg(F.max_by("id", F.struct("updated_at", "id")).alias("task"))


QUERIES = family.queries
