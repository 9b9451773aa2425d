"""Filters, joins, ordering and set operations over the board and index tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.operators.joins import as_of, first_of, next_event, overlapping, point_in_interval
from tidemark.operators.windows import last_n, merge_intervals
from tidemark.operators.evidence import global_rank
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.runtime import load

family = Family()
query = family.query
P = V.PRELUDE
HOUR, DAY = 3_600_000, 86_400_000


def in_scope(c: Column, scopes: list[str]) -> Column:
    """Path equals one of the scopes or lies below it; no scopes means everything."""
    if not scopes:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [(c == s) | c.startswith(s + "/") for s in scopes])


def merge_scopes(stored: list[str], added: list[str]) -> list[str]:
    """Union of path prefixes without those below another one, sorted."""
    both = sorted(set(stored) | set(added))
    return [s for s in both if not any(s != o and s.startswith(o.rstrip("/") + "/") for o in both)]


def all_of(preds: list[Column]) -> Column:
    """Conjunction of predicates; none means true."""
    return reduce(lambda a, b: a & b, preds, F.lit(True))


# ---- projections and filters


@query("P1 S5", P + "SELECT path, coalesce(nullif(tier, ''), 'utility') AS tier, CAST(lines AS BIGINT) AS n_lines, chars, health_score AS health FROM x_files")
def file_projection(spark, d):
    f = V.files(spark, d)
    tier = F.when(F.col("tier") != "", F.col("tier")).otherwise("utility")
    return f.select("path", tier.alias("tier"), F.col("lines").cast("long").alias("n_lines"), "chars", F.col("health_score").alias("health"))


@query("P2 P4 P12 R15", P + "SELECT path, lines FROM x_files WHERE path = 'kits' OR starts_with(path, 'kits/') OR starts_with(path, 'apps/')")
def files_in_scope(spark, d):
    return V.files(spark, d).where(in_scope(F.col("path"), ["kits", "apps"])).select("path", "lines")


_FILTER = P + """SELECT id, state, priority FROM x_tasks WHERE state IN ('queued', 'in_progress', 'blocked') AND priority <= 2
AND parent_id IS NOT NULL AND (title ILIKE '%cursor%' OR description ILIKE '%cursor%') AND coalesce(tier, '') <> 'view' AND title NOT ILIKE 'note:%'"""


@query("P5 P6 R49 R50", _FILTER)
def task_filter(spark, d):
    t = V.tasks(spark, d)
    preds = [
        F.col("state").isin("queued", "in_progress", "blocked"), F.col("priority") <= 2, F.col("parent_id").isNotNull(),
        F.col("title").ilike("%cursor%") | F.col("description").ilike("%cursor%"), F.coalesce("tier", F.lit("")) != "view", ~F.col("title").ilike("note:%"),
    ]
    return t.where(all_of(preds)).select("id", "state", "priority")


@query("P7 O1", P + """SELECT vid, severity, file_path, line FROM (SELECT *, row_number() OVER (ORDER BY severity = 'CRITICAL' DESC, severity = 'HIGH' DESC, file_path, line, vid) AS r
FROM x_violations WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AND rule = 'RULE_3') WHERE r <= 100""")
def violation_filter(spark, d):
    v = V.violations(spark, d).where(F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM") & (F.col("rule") == "RULE_3"))
    top = v.orderBy((F.col("severity") == "CRITICAL").desc(), (F.col("severity") == "HIGH").desc(), "file_path", "line", "vid").limit(100)
    return top.select("vid", "severity", "file_path", "line")


@query("P8", P + "SELECT path, CASE WHEN hazard_count > 0 THEN 'failing' ELSE 'clean' END AS health FROM x_files WHERE hazard_count > 0 OR health_score = 100")
def files_by_health(spark, d):
    f = V.files(spark, d).where((F.col("hazard_count") > 0) | (F.col("health_score") == 100))
    return f.select("path", F.when(F.col("hazard_count") > 0, "failing").otherwise("clean").alias("health"))


_FEED = P + """SELECT id, event_type FROM x_feed WHERE id > 100 AND (event_type = 'commit' OR starts_with(event_type, 'task_'))
AND coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.archived') END, '0') <> '1' AND (thread_id IS NULL OR id = thread_id OR thread_id > 50)"""


@query("P9 P10 P11 N1 R61", _FEED)
def feed_filter(spark, d):
    kind = F.col("event_type")
    open_ = F.coalesce(F.get_json_object("metadata", "$.archived"), F.lit("0")) != "1"
    threads = F.col("thread_id").isNull() | (F.col("id") == F.col("thread_id")) | (F.col("thread_id") > 50)
    return V.feed(spark, d).where((F.col("id") > 100) & ((kind == "commit") | kind.startswith("task_")) & open_ & threads).select("id", "event_type")


@query("P13 P14", P + """SELECT count(*) AS n_calls, count(*) FILTER (handle IS NULL) AS n_unattributed, coalesce(sum(result_chars) FILTER (handle IS NULL), 0)::BIGINT AS chars_unattributed
FROM x_calls WHERE moment BETWEEN 1772500000000 AND 1774000000000""")
def unattributed_calls(spark, d):
    c = V.calls(spark, d).where(F.col("at").between(1772500000000, 1774000000000))
    lost = F.col("handle").isNull()
    return c.agg(F.count("*").alias("n_calls"), F.count_if(lost).alias("n_unattributed"), F.coalesce(F.sum(F.when(lost, F.col("result_chars"))), F.lit(0)).alias("chars_unattributed"))


@query("P15 X14", P + """SELECT path, regexp_matches(path, '\\.spec\\.|\\.test\\.|__tests__') AS is_test,
CASE WHEN path LIKE 'apps/%' THEN 'view' WHEN path LIKE 'kits/%' THEN 'organism' WHEN path LIKE 'packages/%' THEN 'molecule' ELSE 'utility' END AS layer FROM x_files""")
def path_classes(spark, d):
    p = F.col("path")
    layer = F.when(p.startswith("apps/"), "view").when(p.startswith("kits/"), "organism").when(p.startswith("packages/"), "molecule").otherwise("utility")
    return V.files(spark, d).select("path", p.rlike(r"\.spec\.|\.test\.|__tests__").alias("is_test"), layer.alias("layer"))


_MENTION = P + """SELECT id, event_type FROM x_feed WHERE regexp_matches(message, '(?i)@silver-wren([^A-Za-z0-9_-]|$)')"""


@query("P16 P18", _MENTION)
def mentions(spark, d):
    return V.feed(spark, d).where(F.col("message").rlike(r"(?i)@silver-wren(?![\w-])")).select("id", "event_type")


_NOTE = P + """SELECT id, kind FROM (SELECT f.id, CASE WHEN handle_to = 'silver-wren' THEN 'direct' WHEN f.thread_id IN (SELECT id FROM x_feed WHERE author = 'silver-wren') THEN 'reply'
WHEN regexp_matches(message, '@silver-wren([^A-Za-z0-9_-]|$)') THEN 'mention' END AS kind
FROM (SELECT *, """ + N.sql_handle("recipient_id") + """ AS handle_to FROM x_feed) f WHERE author IS DISTINCT FROM 'silver-wren') WHERE kind IS NOT NULL"""


@query("P17 J11", _NOTE)
def notifications(spark, d):
    f = V.feed(spark, d)
    mine = f.where("author = 'silver-wren'").select(F.col("id").alias("thread_id"), F.lit(True).alias("is_mine"))
    kind = (
        F.when(N.handle_key(F.col("recipient_id")) == "silver-wren", "direct").when(F.col("is_mine"), "reply")
        .when(F.col("message").rlike(r"@silver-wren(?![A-Za-z0-9_-])"), "mention")
    )
    others = f.where(~F.col("author").eqNullSafe("silver-wren")).join(mine, "thread_id", "left")
    return others.select("id", kind.alias("kind")).where("kind IS NOT NULL")


@query("P21", P + """SELECT count(*) FILTER (known) AS n_resolved, count(*) FILTER (NOT known) AS n_unresolved, round(100.0 * count(*) FILTER (known) / count(*), 2) AS percent
FROM (SELECT s.id, s.path IN (SELECT path FROM x_files) AS known FROM x_symbols s WHERE s.path IS NOT NULL)""")
def reference_coverage(spark, d):
    known = V.files(spark, d).select("path", F.lit(True).alias("hit"))
    s = V.symbols(spark, d).where("path IS NOT NULL").join(known, "path", "left")
    return s.agg(F.count_if(F.col("hit")).alias("n_resolved"), F.count_if(F.col("hit").isNull()).alias("n_unresolved"), F.round(100.0 * F.count_if(F.col("hit")) / F.count("*"), 2).alias("percent"))


@query("P22 A13 J8", P + """SELECT rule, count(DISTINCT file_path) AS n_files, count(*) AS n_violations, min(severity) AS severity FROM x_violations v
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = v.vid AND l.l_linenumber = 7) GROUP BY rule""")
def rule_groups(spark, d):
    taken = load(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("vid"))
    v = V.violations(spark, d).join(taken, "vid", "left_anti")
    return v.groupBy("rule").agg(F.count_distinct("file_path").alias("n_files"), F.count("*").alias("n_violations"), F.min("severity").alias("severity"))


# ---- joins


@query("J1", P + "SELECT s.id, s.name, s.kind, f.path, f.tier, f.lines FROM x_symbols s JOIN x_files f ON f.path = s.path WHERE s.is_export = 1")
def symbol_definition(spark, d):
    s = V.symbols(spark, d).where("is_export = 1").select("id", "name", "kind", "path")
    return s.join(V.files(spark, d).select("path", "tier", "lines"), "path")


@query("J2", P + "SELECT s.id, s.path, coalesce(f.tier, 'utility') AS tier FROM x_symbols s LEFT JOIN x_files f ON f.path = s.path")
def symbol_references(spark, d):
    tier = V.files(spark, d).select("path", "tier")
    return V.symbols(spark, d).join(tier, "path", "left").select("id", "path", F.coalesce("tier", F.lit("utility")).alias("tier"))


@query("J3 U3", P + """SELECT DISTINCT e.src, t.state FROM x_edges e LEFT JOIN x_tasks t ON t.id = e.src WHERE e.dst IN (SELECT id FROM x_tasks WHERE priority = 1)""")
def dependents_in_list(spark, d):
    t = V.tasks(spark, d)
    keys = t.where("priority = 1").select(F.col("id").alias("dst"))
    src = V.edges(spark, d).join(keys, "dst", "left_semi").select("src").distinct()
    return src.join(t.select(F.col("id").alias("src"), "state"), "src", "left")


@query("J5 A4 G20", P + """SELECT v.file_path, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
count(*) FILTER (severity = 'LOW') AS low, sum(CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 ELSE 1 END)::BIGINT AS weight,
coalesce(any_value(r.n), 0) AS reach, (sum(CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 ELSE 1 END) * (1 + coalesce(any_value(r.n), 0)))::BIGINT AS risk
FROM x_violations v LEFT JOIN (SELECT o_custkey, count(DISTINCT l_suppkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) r ON r.o_custkey = v.file_no
GROUP BY v.file_path HAVING count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) > 0 ORDER BY risk DESC, v.file_path LIMIT 10""")
def hotspot_risk(spark, d):
    """Severity weight of a file times one plus its reach; the ten riskiest."""
    v = V.violations(spark, d)
    sev = lambda s: F.count_if(F.col("severity") == s)
    one = F.when(F.col("severity") == "CRITICAL", 8).when(F.col("severity") == "HIGH", 4).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    per = v.groupBy("file_path", "file_no").agg(sev("CRITICAL").alias("critical"), sev("HIGH").alias("high"), sev("MEDIUM").alias("medium"), sev("LOW").alias("low"), F.sum(one).alias("weight"))
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file_no"))
    pairs = o.join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey")
    reach = pairs.groupBy("file_no").agg(F.count_distinct("l_suppkey").alias("reach"))
    out = per.where("critical + high > 0").join(reach, "file_no", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    out = out.withColumn("risk", F.col("weight") * (1 + F.col("reach"))).drop("file_no")
    return out.orderBy(F.desc("risk"), "file_path").limit(10)


@query("J6", P + """SELECT e.src, e.dst, a.state AS src_state, b.state AS dst_state FROM x_edges e LEFT JOIN x_tasks a ON a.id = e.src AND a.priority = 1 LEFT JOIN x_tasks b ON b.id = e.dst AND b.state <> 'done'""")
def two_step_left_join(spark, d):
    t = V.tasks(spark, d)
    a = t.where("priority = 1").select(F.col("id").alias("src"), F.col("state").alias("src_state"))
    b = t.where("state <> 'done'").select(F.col("id").alias("dst"), F.col("state").alias("dst_state"))
    return V.edges(spark, d).join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "src_state", "dst_state")


@query("J7 J9 U2", P + """SELECT path FROM (SELECT path FROM x_files WHERE hazard_count > 0 UNION SELECT path FROM x_files WHERE health_score < 80)
WHERE path NOT IN (SELECT target_path FROM x_tasks WHERE target_path IS NOT NULL AND state IN ('queued', 'in_progress', 'blocked', 'review'))""")
def unassigned_hazards(spark, d):
    f = V.files(spark, d)
    bad = f.where("hazard_count > 0").select("path").union(f.where("health_score < 80").select("path")).distinct()
    open_ = V.tasks(spark, d).where(F.col("state").isin("queued", "in_progress", "blocked", "review")).select(F.col("target_path").alias("path"))
    return bad.join(open_, "path", "left_anti")


@query("J10", P + """SELECT id FROM x_tasks t WHERE NOT EXISTS (SELECT 1 FROM x_tasks c WHERE c.parent_id = t.id AND c.state NOT IN ('done', 'duplicate', 'cancelled', 'deleted'))""")
def leaf_tasks(spark, d):
    t = V.tasks(spark, d)
    open_ = t.where(~F.col("state").isin(V.CLOSED)).select(F.col("parent_id").alias("id"))
    return t.join(open_, "id", "left_anti").select("id")


@query("J12 R59 A42", P + """SELECT a.id, count(t.id) FILTER (t.state = 'in_progress') AS n_open, count(t.id) FILTER (t.state = 'done') AS n_done,
(SELECT max(f.id) FROM x_feed f WHERE f.author = a.handle) AS last_post FROM x_agents a LEFT JOIN x_tasks t ON t.handle = a.handle GROUP BY a.id, a.handle""")
def agent_directory(spark, d):
    t = V.tasks(spark, d).groupBy("handle").agg(F.count_if(F.col("state") == "in_progress").alias("n_open"), F.count_if(F.col("state") == "done").alias("n_done"))
    f = V.feed(spark, d).groupBy(F.col("author").alias("handle")).agg(F.max("id").alias("last_post"))
    out = V.agents(spark, d).select("id", "handle").join(t, "handle", "left").join(f, "handle", "left")
    return out.select("id", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.coalesce("n_done", F.lit(0)).alias("n_done"), "last_post")


@query("J13 O3 O4 O5 O13", P + """SELECT id, priority, updated_at, (SELECT count(*) FROM x_tasks WHERE state <> 'deleted') AS total
FROM x_tasks WHERE state <> 'deleted' ORDER BY priority, updated_at DESC, id LIMIT 25 OFFSET 50""")
def page_of_tasks(spark, d, limit: int = 25, offset: int = 50):
    """A page by priority, then the latest change, with the exact total."""
    t = V.tasks(spark, d).where("state <> 'deleted'").select("id", "priority", "updated_at")
    page = t.orderBy("priority", F.desc("updated_at"), "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(t.agg(F.count("*").alias("total"))))  # a single row


@query("J14 R44", P + "SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey AND n.n_name LIKE 'N%'")
def alias_left(spark, d):
    n = load(spark, d, "nation").where("n_name LIKE 'N%'").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return load(spark, d, "region").join(n, "r_regionkey", "left").select("r_name", "n_name")


@query("J15 R41", P + """SELECT u.run_id, u.agent_key, u.task_id, t.state FROM x_usage u JOIN x_tasks t ON t.id = u.task_id WHERE u.agent_key IS NOT NULL""")
def run_tasks(spark, d):
    t = V.tasks(spark, d).select(F.col("id").alias("task_id"), "state")
    return V.usage(spark, d).where("agent_key IS NOT NULL").join(t, "task_id").select("run_id", "agent_key", "task_id", "state")


@query("J16 R29", P + """SELECT DISTINCT b.id FROM x_blueprints b WHERE EXISTS (SELECT 1 FROM x_fills f WHERE f.bp = b.bp AND f.valid = 0)""")
def unnotified_jobs(spark, d):
    open_ = V.fills(spark, d).where("valid = 0").select("bp")
    return V.blueprints(spark, d).join(open_, "bp", "left_semi").select("id").distinct()


@query("J17", P + """SELECT run_id, agent_key, task FROM (SELECT u.run_id, u.agent_key, t.id AS task, row_number() OVER (PARTITION BY u.run_id, u.agent_key ORDER BY t.updated_at DESC, t.id DESC) AS r
FROM x_usage u JOIN x_tasks t ON t.handle = u.who AND t.created_at <= u.ended AND t.updated_at >= u.began WHERE u.agent_key IS NOT NULL AND u.began <= u.ended AND t.created_at <= t.updated_at) WHERE r = 1""")
def overlap_interval_join(spark, d):
    """The latest task of the same handle whose life overlaps a run's window."""
    u = V.usage(spark, d).where("agent_key IS NOT NULL").select("run_id", "agent_key", F.col("who").alias("handle"), "began", "ended")
    t = V.tasks(spark, d).select("handle", F.col("id").alias("task"), "created_at", "updated_at")
    pairs = overlapping(u, t, "handle", ("began", "ended"), ("created_at", "updated_at"), 7 * DAY)
    return first_of(pairs, ["run_id", "agent_key"], [F.desc("updated_at"), F.desc("task")]).select("run_id", "agent_key", "task")


_WINDOWS = """spans AS (SELECT who, began, ended FROM x_usage WHERE who IS NOT NULL AND began IS NOT NULL AND ended IS NOT NULL),
flags AS (SELECT *, CASE WHEN began <= max(ended) OVER (PARTITION BY who ORDER BY began, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY who ORDER BY began, ended ROWS UNBOUNDED PRECEDING) AS i FROM flags),
merged AS (SELECT who, min(began) AS began, max(ended) AS ended, count(*) AS n_merged FROM numbered GROUP BY who, i)"""


@query("W4 W5 D3", P + "," + _WINDOWS + " SELECT who, began, ended, n_merged FROM merged")
def handle_windows(spark, d):
    return merge_intervals(V.usage(spark, d).where("who IS NOT NULL").select("who", "began", "ended"), ["who"], "began", "ended")


@query("J18 J19", P + "," + _WINDOWS + """ SELECT w.who AS handle, w.began, count(*) AS n_posts, coalesce(sum(length(f.message)), 0)::BIGINT AS chars
FROM merged w JOIN x_feed f ON f.author = w.who AND f.moment BETWEEN w.began AND w.ended GROUP BY w.who, w.began""")
def posts_in_windows(spark, d):
    """Posts inside their author's merged working windows."""
    w = handle_windows(spark, d).select(F.col("who").alias("handle"), "began", "ended")
    c = V.feed(spark, d).where("author IS NOT NULL AND at IS NOT NULL").select(F.col("author").alias("handle"), "at", F.length("message").alias("size"))
    hits = point_in_interval(c, w, "handle", "at", "began", "ended", 6 * HOUR)
    return hits.groupBy("handle", "began").agg(F.count("*").alias("n_posts"), F.coalesce(F.sum("size"), F.lit(0)).alias("chars"))


_LOCK = P + """, locks AS (SELECT file_path, id, moment, CASE WHEN event_type = 'lock_released' THEN '-' ELSE coalesce(author, '-') END AS who, event_type FROM x_feed WHERE event_type IN ('lock_acquired', 'lock_released') AND moment IS NOT NULL AND file_path IS NOT NULL),
probes AS (SELECT id, file_path, moment FROM x_feed WHERE event_type = 'lock_queued' AND moment IS NOT NULL AND file_path IS NOT NULL)
SELECT p.id, arg_max(l.who, (l.moment, l.id)) FILTER (l.id IS NOT NULL) AS holder FROM probes p LEFT JOIN locks l ON l.file_path = p.file_path AND l.moment <= p.moment GROUP BY p.id"""


@query("J20", _LOCK)
def asof_holder(spark, d):
    """Who held a file when somebody queued for it: '-' after a release, null if it was never held."""
    f = V.feed(spark, d).where("at IS NOT NULL AND file_path IS NOT NULL")
    who = F.when(F.col("event_type") == "lock_released", "-").otherwise(F.coalesce("author", F.lit("-")))
    locks = f.where(F.col("event_type").isin("lock_acquired", "lock_released")).select("file_path", "at", "id", who.alias("holder"))
    probes = f.where("event_type = 'lock_queued'").select("id", "file_path", "at")
    return as_of(probes, locks, "file_path", "at", "id", ["holder"]).select("id", "holder")


@query("J21", P + """SELECT q.id, min(e.moment) - any_value(q.moment) AS wait_ms FROM x_feed q LEFT JOIN x_feed e ON e.event_type = 'lock_acquired' AND e.file_path = q.file_path AND e.moment >= q.moment
WHERE q.event_type = 'lock_queued' AND q.moment IS NOT NULL AND q.file_path IS NOT NULL GROUP BY q.id""")
def next_event_wait(spark, d):
    f = V.feed(spark, d).where("at IS NOT NULL AND file_path IS NOT NULL")
    waits = f.where("event_type = 'lock_queued'").select("id", "file_path", "at")
    got = f.where("event_type = 'lock_acquired'").select("file_path", "at")
    return next_event(waits, got, ["file_path"], "at", "granted").select("id", (F.col("granted") - F.col("at")).alias("wait_ms"))


@query("J22", P + """SELECT a.id AS outer_id, b.id AS inner_id FROM x_symbols a JOIN x_symbols b ON a.path = b.path AND a.id <> b.id AND a.start_line <= b.start_line AND b.end_line <= a.end_line
AND a.end_line - a.start_line > b.end_line - b.start_line AND b.start_line <= b.end_line""")
def span_containment(spark, d):
    """Spans of a file that strictly contain another one."""
    s = V.symbols(spark, d).where("path IS NOT NULL")
    outer = s.select("path", F.col("id").alias("outer_id"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    inner = s.select("path", F.col("id").alias("inner_id"), F.col("start_line").alias("c"), F.col("end_line").alias("e"))
    pairs = overlapping(outer, inner, "path", ("a", "b"), ("c", "e"), 200)
    return pairs.where("a <= c AND e <= b AND b - a > e - c AND outer_id <> inner_id").select("outer_id", "inner_id")


@query("J25 A44", P + """SELECT coalesce(thread_id, id) AS topic, count(*) FILTER (thread_id IS NOT NULL) AS n_replies, arg_max(id, (coalesce(moment, 0), id)) AS last_post FROM x_feed GROUP BY coalesce(thread_id, id)""")
def topics(spark, d):
    latest = F.max_by("id", F.struct(F.coalesce("at", F.lit(0)), "id"))
    return V.feed(spark, d).groupBy(F.coalesce("thread_id", "id").alias("topic")).agg(F.count("thread_id").alias("n_replies"), latest.alias("last_post"))


@query("J26", P + """SELECT name, id, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_export DESC, path, start_line, id) AS r FROM x_symbols WHERE path IS NOT NULL AND name IS NOT NULL) WHERE r = 1""")
def preferred_definition(spark, d):
    s = V.symbols(spark, d).where("path IS NOT NULL AND name IS NOT NULL")
    return first_of(s, ["name"], [F.desc("is_export"), F.col("path"), F.col("start_line"), F.col("id")]).select("name", "id", "path")


# ---- ordering and paging


@query("O2 O13 W1 U1", P + """, hits AS (SELECT path, name, start_line AS line, CASE WHEN name = 'hashToken' AND is_export = 1 THEN 5 WHEN name = 'hashToken' THEN 4 ELSE 2 END AS rank FROM x_symbols WHERE name ILIKE '%hash%' AND path IS NOT NULL
UNION ALL SELECT path, NULL, NULL, 3 FROM x_files WHERE path ILIKE '%hash%'),
best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank DESC, line NULLS LAST, name) AS r FROM hits)
SELECT b.path, b.rank, b.line FROM best b JOIN x_files f ON f.path = b.path WHERE r = 1 ORDER BY b.rank DESC, f.lines, b.path LIMIT 50""")
def best_hits(spark, d, text: str = "hash", exact: str = "hashToken"):
    """Best hit of each file, by kind of match, then by length and path."""
    f = V.files(spark, d)
    s = V.symbols(spark, d).where(F.col("name").ilike(f"%{text}%") & F.col("path").isNotNull())
    rank = F.when((F.col("name") == exact) & (F.col("is_export") == 1), 5).when(F.col("name") == exact, 4).otherwise(2)
    hits = s.select("path", "name", F.col("start_line").alias("line"), rank.alias("rank"))
    paths = f.where(F.col("path").ilike(f"%{text}%")).select("path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), F.lit(3).alias("rank"))
    best = first_of(hits.unionByName(paths), ["path"], [F.desc("rank"), F.col("line").asc_nulls_last(), F.col("name")])
    return best.join(f.select("path", "lines"), "path").orderBy(F.desc("rank"), "lines", "path").limit(50).select("path", "rank", "line")


@query("O6", P + "SELECT id, event_type FROM (SELECT * FROM x_feed WHERE id < 4000 ORDER BY id DESC LIMIT 40)")
def keyset_page(spark, d, before: int = 4000, limit: int = 40):
    return V.feed(spark, d).where(F.col("id") < before).orderBy(F.desc("id")).limit(limit).select("id", "event_type")


@query("O7 W7", P + "SELECT id, state FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY priority, updated_at DESC, id) AS r FROM x_tasks) WHERE r <= 20")
def board_first_page(spark, d):
    return last_n(V.tasks(spark, d), ["state"], [F.col("priority"), F.desc("updated_at"), F.col("id")], 20).select("id", "state")


@query("O8 O9", P + "SELECT id, row_number() OVER (ORDER BY lower(id), id) AS place FROM x_agents")
def nocase_order(spark, d):
    """Directory order without letter case."""
    return global_rank(V.agents(spark, d).select("id"), [], [F.lower("id"), F.col("id")], "place")


@query("O10 W14 R23", P + """SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY moment, id) AS place FROM x_feed WHERE event_type = 'lock_queued' AND file_path IS NOT NULL AND moment IS NOT NULL""")
def queue_position(spark, d):
    q = V.feed(spark, d).where("event_type = 'lock_queued' AND file_path IS NOT NULL AND at IS NOT NULL")
    return q.select("id", "file_path", F.row_number().over(Window.partitionBy("file_path").orderBy("at", "id")).cast("long").alias("place"))


@query("O12", P + """SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY path ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'component' THEN 1 WHEN 'function' THEN 2 ELSE 3 END, start_line, id) AS r FROM x_symbols WHERE path IS NOT NULL) WHERE r <= 40""")
def units_per_file(spark, d, cap: int = 40):
    """At most ``cap`` units of a file, by kind: the cap is the feature."""
    kind = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "component", 1).when(F.col("kind") == "function", 2).otherwise(3)
    return last_n(V.symbols(spark, d).where("path IS NOT NULL"), ["path"], [kind, F.col("start_line"), F.col("id")], cap).select("id")


# ---- sets


@query("U4 S19 R20 R40", P + """SELECT handle, id AS last_call, verb FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY moment DESC, id DESC) AS r FROM x_calls WHERE handle IS NOT NULL AND moment IS NOT NULL) WHERE r = 1""")
def upsert_latest(spark, d):
    """The last writer of each key wins."""
    c = V.calls(spark, d).where("handle IS NOT NULL AND at IS NOT NULL")
    return c.groupBy("handle").agg(F.max(F.struct("at", "id", "verb")).alias("r")).select("handle", F.col("r.id").alias("last_call"), "r.verb")


@query("U5 R37", P + "SELECT task_id, arg_min(id, (coalesce(moment, 9e18), id)) AS first_post FROM x_feed WHERE task_id IS NOT NULL GROUP BY task_id")
def insert_ignore(spark, d):
    """The first writer of each key wins; later ones are ignored."""
    first = F.min_by("id", F.struct(F.coalesce("at", F.lit(9 * 10**18)), "id"))
    return V.feed(spark, d).where("task_id IS NOT NULL").groupBy("task_id").agg(first.alias("first_post"))


@query("U6 U7", P + """SELECT vid FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line, rule ORDER BY vid) AS r FROM x_violations) v WHERE r = 1
AND NOT (rule = 'RULE_2' AND EXISTS (SELECT 1 FROM x_violations w WHERE w.file_path = v.file_path AND w.line = v.line AND w.rule = 'RULE_1'))""")
def dedupe_first(spark, d):
    """First finding of each site and rule; a weaker twin rule gives way to the stronger one on the same site."""
    v = V.violations(spark, d)
    first = v.groupBy("file_path", "line", "rule").agg(F.min("vid").alias("vid"))
    strong = v.where("rule = 'RULE_1'").select("file_path", "line", F.lit("RULE_2").alias("rule"))
    return first.join(strong, ["file_path", "line", "rule"], "left_anti").select("vid")


@query("U9 A35 A36", P + """, b AS (SELECT rule, count(*) AS n FROM x_violations WHERE found_on < TIMESTAMP '1998-06-01' GROUP BY rule), a AS (SELECT rule, count(*) AS n FROM x_violations WHERE found_on >= TIMESTAMP '1998-06-01' GROUP BY rule)
SELECT coalesce(a.rule, b.rule) AS rule, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS rise FROM a FULL JOIN b ON a.rule = b.rule WHERE coalesce(a.n, 0) > coalesce(b.n, 0)""")
def delta_gate(spark, d):
    """Rules with more findings after a change than before."""
    v = V.violations(spark, d)
    n = lambda late: F.count_if((F.col("found_on") >= F.lit("1998-06-01").cast("timestamp_ntz")) == late)
    per = v.groupBy("rule").agg(n(F.lit(False)).alias("n_before"), n(F.lit(True)).alias("n_after"))
    return per.withColumn("rise", F.col("n_after") - F.col("n_before")).where("rise > 0")


@query("U9", P + """SELECT rule, severity, count(*) AS n FROM (SELECT rule, severity FROM x_violations WHERE state = 'O' EXCEPT ALL SELECT rule, severity FROM x_violations WHERE state = 'F') GROUP BY rule, severity""")
def new_sites(spark, d):
    """Multiset difference of findings, counted."""
    v = V.violations(spark, d)
    new = v.where("state = 'O'").select("rule", "severity").exceptAll(v.where("state = 'F'").select("rule", "severity"))
    return new.groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("U10 S18", P + "SELECT path FROM x_files WHERE path NOT IN (SELECT path FROM x_symbols WHERE path IS NOT NULL)")
def unindexed_files(spark, d):
    return V.files(spark, d).select("path").join(V.symbols(spark, d).select("path"), "path", "left_anti")


@query("U11 R2 T15", P + """SELECT coalesce(f.path, s.path) AS path, CASE WHEN f.path IS NULL THEN 'orphan' WHEN s.path IS NULL THEN 'empty' WHEN s.newest > f.synced_at THEN 'ahead' ELSE 'existing' END AS status
FROM x_files f FULL JOIN (SELECT path, max(indexed_at) AS newest FROM x_symbols WHERE path IS NOT NULL GROUP BY path) s ON s.path = f.path""")
def set_partition(spark, d):
    """Index state of every path on either side."""
    f = V.files(spark, d).select("path", "synced_at")
    s = V.symbols(spark, d).where("path IS NOT NULL").groupBy(F.col("path").alias("spath")).agg(F.max("indexed_at").alias("newest"))
    status = F.when(F.col("path").isNull(), "orphan").when(F.col("spath").isNull(), "empty").when(F.col("newest") > F.col("synced_at"), "ahead").otherwise("existing")
    return f.join(s, F.col("path") == F.col("spath"), "full_outer").select(F.coalesce("path", "spath").alias("path"), status.alias("status"))


QUERIES = family.queries
