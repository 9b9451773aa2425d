"""Queries of index records, ledger writes, leases, test selection, judging and tree fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import normalize as N
from tidemark.operators import evidence
from tidemark.operators.graph import reach
from tidemark.operators.hierarchy import resolve_hierarchy
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.runtime import load
from tidemark.sources import records, scan, store
from tidemark.streaming.runner import stream_folder

family = Family()
query = family.query
P = V.PRELUDE

# ---- index records and writes

_DECLARED = "(?m)^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?(?:(?:function|class)\\s+([A-Za-z_$][\\w$]*)|(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)\\s*=|def\\s+([A-Za-z_]\\w*))"


@query("S3", f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, list_concat(list_concat(regexp_extract_all(text, '{_DECLARED}', 1), regexp_extract_all(text, '{_DECLARED}', 2)), regexp_extract_all(text, '{_DECLARED}', 3)) AS names FROM d)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines,
CAST(length(text) AS BIGINT) AS chars, sha1(text) AS sha1, CAST(len(list_distinct(list_filter(names, lambda x: x <> ''))) AS INTEGER) AS n_symbols,
CAST(len(list_distinct(regexp_extract_all(text, '\\b(use[A-Z]\\w*)\\s*\\(', 1))) AS INTEGER) AS n_hooks FROM s""")
def file_records(spark, d):
    """Index records of all documents: sizes, digest and how many names each declares."""
    files = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return scan.index_records(files).select("path", "size", "lines", "chars", "sha1", F.size("symbols").alias("n_symbols"), F.size("hooks").alias("n_hooks"))


@query("S24", P + """SELECT event_type, count(*) AS n FROM (SELECT event_type FROM x_feed UNION ALL SELECT 'task_reopened' FROM x_tasks WHERE state = 'blocked') GROUP BY event_type""")
def appended_posts(spark, d):
    """A stored feed to which posts about blocked tasks are appended, read back."""
    path = f"{stream_folder(spark)}/feed"
    feed = V.feed(spark, d).select("id", "task_id", "event_type")
    store.append(feed, path)
    last = F.broadcast(feed.agg(F.max("id").alias("last")))  # a single row
    fresh = V.tasks(spark, d).where("state = 'blocked'").select("id").crossJoin(last)
    store.append(fresh.select((F.col("last") + F.col("id")).alias("id"), F.col("id").alias("task_id"), F.lit("task_reopened").alias("event_type")), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("S23", P + """, h AS (SELECT path, count(*) AS n FROM x_symbols WHERE path IS NOT NULL AND kind = 'class' GROUP BY path)
SELECT f.path, CAST(coalesce(h.n, 0) AS INTEGER) AS hazard_count, CAST(greatest(0, 100 - 15 * coalesce(h.n, 0)) AS INTEGER) AS health_score FROM x_files f LEFT JOIN h ON h.path = f.path""")
def restamped_health(spark, d):
    """Health of every file from its findings (classes stand in for them): 15 points each, not below 0; written over the stored table."""
    path = f"{stream_folder(spark)}/files"
    files = V.files(spark, d)
    files.select("path", "hazard_count", "health_score").write.parquet(path)
    found = V.symbols(spark, d).where("path IS NOT NULL AND kind = 'class'").groupBy("path").agg(F.count("*").cast("int").alias("n"))
    n = F.coalesce("n", F.lit(0))
    store.swap(spark.read.parquet(path).join(found, "path", "left").select("path", n.alias("hazard_count"), F.greatest(F.lit(0), 100 - 15 * n).alias("health_score")), path)
    return spark.read.parquet(path)


@query("S23", P + """SELECT state AS scope, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity IN ('HIGH', 'MEDIUM')) AS high_med, count(*) FILTER (severity = 'LOW') AS low FROM x_violations GROUP BY state""")
def audit_snapshots(spark, d):
    """Snapshots appended one after another, one row each."""
    path = f"{stream_folder(spark)}/snapshots"
    v = V.violations(spark, d)
    for state in ("F", "O", "P"):
        count = lambda *s: F.count_if(F.col("severity").isin(*s))
        store.append(v.where(F.col("state") == state).agg(F.lit(state).alias("scope"), count("CRITICAL").alias("critical"), count("HIGH", "MEDIUM").alias("high_med"), count("LOW").alias("low")), path)
    return spark.read.parquet(path)


@query("S20", P + "SELECT path, lines FROM x_files WHERE content_hash IS NOT NULL AND lines % 3 <> 0")
def seeded_index(spark, d):
    """Rows of an index that a new checkout can take over: those whose path and content are the same there. A third of its files has changed."""
    f = V.files(spark, d).where("content_hash IS NOT NULL")
    changed = F.when(F.col("lines") % 3 == 0, F.concat("content_hash", F.lit("0"))).otherwise(F.col("content_hash"))
    return store.seed_from(f, f.select("path", changed.alias("content_hash")), ["path", "content_hash"]).select("path", "lines")


@query("S13", P + "SELECT '- ' || event_type || ': ' || id AS line FROM x_feed WHERE moment IS NOT NULL AND event_type = 'decision'")
def exported_notes(spark, d):
    """Decisions exported as list lines in two turns, the second from the cursor of the first on."""
    folder = stream_folder(spark)
    f = V.feed(spark, d).where("at IS NOT NULL AND event_type = 'decision'").select("at", F.col("event_type").alias("kind"), F.col("id").cast("string").alias("note"))
    half = f.agg(F.percentile_approx("at", 0.5)).first()[0]
    for part in (f.where(F.col("at") <= F.lit(half)), f):
        records.export_since(part, "at", f"{folder}/cursor.json", f"{folder}/notes")
    return spark.read.text(f"{folder}/notes").select(F.col("value").alias("line"))


@query("S15", "SELECT 'a' AS ledger, count(*) AS n FROM files UNION ALL SELECT 'b', count(*) FROM blueprints")
def discovered_ledgers(spark, d):
    """Ledgers found at most four folders deep and read together; one that lies deeper is left alone."""
    root = stream_folder(spark)
    for path, name in (("a", "files"), ("x/y/z/b", "blueprints"), ("x/y/z/w/v/c", "nation")):
        load(spark, d, name).select(F.lit(path[-1]).alias("ledger")).write.parquet(f"{root}/{path}/ledger")
    found = records.discover(root, "ledger")
    frame, errors = records.federated(spark, {p: p for p in found}, T.StructType([T.StructField("ledger", T.StringType())]))
    if errors:
        raise ValueError(f"unreadable: {errors}")
    return frame.groupBy("ledger").agg(F.count("*").alias("n"))


@query("S11", "SELECT count(*) FILTER (json_valid(metadata)) AS n_records, count(*) FILTER (NOT json_valid(metadata)) AS n_malformed FROM agent_feed WHERE trim(metadata) <> ''")
def counted_lines(spark, d):
    """A log of JSON lines, some of them torn, with how many are."""
    path = stream_folder(spark)
    load(spark, d, "agent_feed").where("metadata IS NOT NULL").select(F.col("metadata").alias("value")).write.text(path)
    return records.read_jsonl_counted(spark, path, T.StructType([T.StructField("run", T.LongType())]))[1]


# ---- board


@query("R10 R34", P + """, b AS (SELECT handle, max(moment) AS beat FROM x_calls WHERE handle IS NOT NULL AND moment IS NOT NULL GROUP BY handle),
a AS (SELECT handle, max(heartbeat) AS heartbeat FROM x_agents GROUP BY handle)
SELECT coalesce(a.handle, b.handle) AS handle, nullif(greatest(coalesce(a.heartbeat, 0), coalesce(b.beat, 0)), 0) AS heartbeat, a.handle IS NULL AS is_new FROM a FULL OUTER JOIN b ON a.handle = b.handle""")
def heartbeats(spark, d):
    """Heartbeats by the latest sign of life; callers that nobody registered are registered."""
    beats = V.calls(spark, d).where("handle IS NOT NULL AND at IS NOT NULL").groupBy("handle").agg(F.max("at").alias("beat"))
    known = V.agents(spark, d).groupBy("handle").agg(F.max("heartbeat").alias("heartbeat"), F.lit(True).alias("known"))
    j = known.join(beats, "handle", "full_outer")
    return j.select("handle", F.nullif(F.greatest(F.coalesce("heartbeat", F.lit(0)), F.coalesce("beat", F.lit(0))), F.lit(0)).alias("heartbeat"), F.col("known").isNull().alias("is_new"))


@query("R12", P + "SELECT id FROM x_tasks t WHERE EXISTS (SELECT 1 FROM x_tasks o WHERE o.title = t.title AND o.id <> t.id AND o.state NOT IN ('done', 'duplicate', 'cancelled', 'deleted'))")
def same_title_open(spark, d):
    """Tasks for which another open task has the same title. Open ones are counted per title, so a title that many share makes no pairs."""
    t = V.tasks(spark, d).select("id", "title", (~F.col("state").isin(V.CLOSED)).alias("open"))
    n = t.where("open AND title IS NOT NULL").groupBy("title").agg(F.count("*").alias("n"))
    return t.join(n, "title").where(F.col("n") > F.coalesce("open", F.lit(False)).cast("int")).select("id")


_CLOSED = P + """, c AS (SELECT id, parent_id AS target FROM x_tasks WHERE state IN ('duplicate', 'done', 'cancelled') AND parent_id > 0 AND parent_id <> id),
walk AS (SELECT target AS id, target AS last, 0 AS hops FROM c WHERE target NOT IN (SELECT id FROM c) GROUP BY target
  UNION ALL SELECT c.id, w.last, w.hops + 1 FROM walk w JOIN c ON c.target = w.id)"""


@query("R51", _CLOSED + " SELECT id, last AS original, CAST(hops AS BIGINT) AS hops FROM walk WHERE hops > 0")
def duplicate_chains(spark, d):
    """The original that each closed task leads to over duplicate-of links of close events, the latest event of a task holding.

    The feed has no such events, so closed tasks with a parent write one each, after an older one with another target; torn metadata links nothing.
    """
    t = V.tasks(spark, d).where("state IN ('duplicate', 'done', 'cancelled') AND parent_id > 0 AND parent_id <> id")
    event = lambda seq, meta: F.struct(F.lit(seq).alias("seq"), meta.alias("metadata"))
    link = lambda c: F.to_json(F.struct(c.alias("duplicate_of")))
    written = F.array(event(1, link(F.col("id") + 1)), event(2, link(F.col("parent_id"))), event(3, F.lit("{torn")))
    events = t.select(F.col("id").alias("task_id"), F.explode(written).alias("e")).select("task_id", "e.*")
    return duplicate_links(events)


def duplicate_links(events: DataFrame) -> DataFrame:
    """id, original and hops of ``events`` (task_id, seq, metadata): the latest event with a readable duplicate_of holds; circles have no original."""
    target = F.from_json("metadata", "duplicate_of long", {"mode": "PERMISSIVE"})["duplicate_of"]
    links = events.withColumn("target", target).where("task_id IS NOT NULL AND target > 0").groupBy("task_id").agg(F.max_by("target", "seq").alias("target"))
    ends = links.select(F.col("target").alias("id")).distinct().join(links.select(F.col("task_id").alias("id")), "id", "left_anti")
    nodes = links.select(F.col("task_id").alias("id"), F.col("target").alias("parent_id")).unionByName(ends.withColumn("parent_id", F.lit(None).cast("long")))
    return resolve_hierarchy(nodes).where("depth > 0").select("id", F.col("root_id").alias("original"), F.col("depth").alias("hops"))


_LEASES = P + """, l AS (SELECT file_path, arg_max(event_type, (moment, id)) AS kind, arg_max(author, (moment, id)) AS holder, max(moment) AS got FROM x_feed
WHERE event_type IN ('lock_acquired', 'lock_released') AND file_path IS NOT NULL AND moment IS NOT NULL AND author IS NOT NULL GROUP BY file_path),
live AS (SELECT file_path, holder, got AS acquired_at FROM l WHERE kind = 'lock_acquired')"""


def _live_leases(spark, d) -> DataFrame:
    f = V.feed(spark, d).where("event_type IN ('lock_acquired', 'lock_released') AND file_path IS NOT NULL AND at IS NOT NULL AND author IS NOT NULL")
    last = f.groupBy("file_path").agg(F.max_by(F.struct("event_type", "author", "at"), F.struct("at", "id")).alias("l"))
    return last.where("l.event_type = 'lock_acquired'").select("file_path", F.col("l.author").alias("holder"), F.col("l.at").alias("acquired_at"))


@query("R24 R3", _LEASES + """, q AS (SELECT f.file_path, count(DISTINCT f.author) AS n_waiting FROM x_feed f JOIN live ON live.file_path = f.file_path AND f.moment > live.acquired_at AND f.author <> live.holder WHERE f.event_type = 'lock_queued' GROUP BY f.file_path)
SELECT live.file_path, holder, acquired_at, n_waiting FROM live JOIN q ON q.file_path = live.file_path""")
def contested_leases(spark, d):
    """Map of held files that others have asked for since."""
    live = _live_leases(spark, d)
    asked = V.feed(spark, d).where("event_type = 'lock_queued'").select("file_path", "author", "at")
    waiting = asked.join(live, "file_path").where("at > acquired_at AND author <> holder").groupBy("file_path").agg(F.count_distinct("author").alias("n_waiting"))
    return live.join(waiting, "file_path")


@query("R30", _LEASES + ", s AS (SELECT DISTINCT file_path, author FROM x_feed WHERE event_type = 'commit' AND file_path IS NOT NULL AND author IS NOT NULL) SELECT s.file_path, s.author AS committer, live.holder FROM s JOIN live ON live.file_path = s.file_path AND live.holder <> s.author")
def staged_held_by_others(spark, d):
    """Files of commits that another agent holds."""
    staged = V.feed(spark, d).where("event_type = 'commit' AND file_path IS NOT NULL AND author IS NOT NULL").select("file_path", F.col("author").alias("committer")).distinct()
    return staged.join(_live_leases(spark, d), "file_path").where("holder <> committer").select("file_path", "committer", "holder")


@query("R22", _LEASES + """, m AS (SELECT file_path, arg_max(author, (moment, id)) AS editor, max(moment) AS edited_at FROM x_feed WHERE event_type = 'status_update' AND file_path IS NOT NULL AND moment IS NOT NULL AND author IS NOT NULL GROUP BY file_path)
SELECT live.file_path, CASE WHEN m.editor = live.holder THEN greatest(live.acquired_at, m.edited_at) ELSE live.acquired_at END AS last_edit FROM live LEFT JOIN m ON m.file_path = live.file_path""")
def last_edits(spark, d):
    """When the holder of a lease last edited the file: its own latest mark, or the time of the lease."""
    f = V.feed(spark, d).where("event_type = 'status_update' AND file_path IS NOT NULL AND at IS NOT NULL AND author IS NOT NULL")
    marks = f.groupBy("file_path").agg(F.max_by("author", F.struct("at", "id")).alias("editor"), F.max("at").alias("edited_at"))
    own = F.when(F.col("editor") == F.col("holder"), F.greatest("acquired_at", "edited_at")).otherwise(F.col("acquired_at"))
    return _live_leases(spark, d).join(marks, "file_path", "left").select("file_path", own.alias("last_edit"))


#: Size class of points; from 21 points on it is epic.
SIZE_CLASSES = {1: "sand", 2: "pebbles", 3: "pebbles", 5: "rocks", 8: "boulders", 13: "boulders"}


@query("M19", P + "SELECT id, CASE WHEN priority * 5 >= 21 THEN 'epic' WHEN priority * 5 = 5 THEN 'rocks' ELSE 'unknown' END AS size_class FROM x_tasks")
def size_classes(spark, d):
    """Size class of points, for which five times the priority stands in."""
    points = F.col("priority") * 5
    out = F.when(points >= 21, "epic")
    for p, name in SIZE_CLASSES.items():
        out = out.when(points == p, name)
    return V.tasks(spark, d).select("id", out.otherwise("unknown").alias("size_class"))


def resolve_since(raw: str | float | None, now: F.Column) -> F.Column:
    """Epoch milliseconds of ``raw`` where it is a positive number, else midnight before ``now`` (ms) in the session's time zone."""
    try:
        ms = float(raw) if raw not in (None, "") else 0.0
    except ValueError:
        ms = 0.0
    midnight = F.unix_millis(F.date_trunc("DAY", F.timestamp_millis(now)))
    return F.lit(int(ms)).cast("long") if 0 < ms < float("inf") else midnight


@query("D1 D2", P + ", t AS (SELECT max(moment) AS now FROM x_feed) SELECT event_type, count(*) AS n FROM x_feed, t WHERE moment >= (now // 86400000) * 86400000 GROUP BY event_type")
def events_since_midnight(spark, d, since: str | None = None):
    """Events by type since ``since``, or since the local midnight before the latest one."""
    f = V.feed(spark, d)
    start = f.agg(resolve_since(since, F.max("at")).alias("since")).scalar()
    return f.where(F.col("at") >= start).groupBy("event_type").agg(F.count("*").alias("n"))


@query("V7", P + "SELECT file_path, start_line AS line FROM x_symbols WHERE name = (SELECT min(name) FROM x_symbols) AND file_path IS NOT NULL")
def occurrences_function(spark, d):
    """Occurrences of a name by a table-valued SQL function."""
    s = V.symbols(spark, d)
    s.createOrReplaceTempView("tidemark_symbols")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION occurrences_of(wanted STRING) RETURNS TABLE (file_path STRING, line INT) RETURN SELECT file_path, start_line FROM tidemark_symbols WHERE name = wanted AND file_path IS NOT NULL")
    name = s.agg(F.min("name")).first()[0] or ""
    return spark.sql("SELECT file_path, line FROM occurrences_of(:name)", args={"name": name})


# ---- test selection, templates, judging, fingerprints


@query("G10 G12", P + """, ch AS (SELECT id, target_path FROM x_tasks WHERE priority = 1 AND state <> 'deleted'), gone AS (SELECT id FROM x_tasks WHERE priority = 1 AND state = 'deleted'),
r AS (SELECT id FROM ch UNION SELECT e.src FROM r JOIN x_edges e ON e.dst = r.id), spec AS (SELECT id, target_path FROM x_tasks WHERE id % 3 = 0),
first_ AS (SELECT e.src AS id FROM x_edges e JOIN r ON r.id = e.dst),
why AS (SELECT id, 'changed' AS reason FROM ch UNION SELECT s.id, 'colocated' FROM spec s JOIN ch ON ch.target_path = s.target_path AND ch.id <> s.id UNION SELECT id, 'depends' FROM first_)
SELECT s.id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM spec s JOIN why w ON w.id = s.id GROUP BY s.id""")
def affected_specs(spark, d):
    """Specs (tasks with ids divisible by 3) that changed tasks (of priority 1) reach, with all reasons: changed, in the same place, or depends on one at any distance.

    All changes start from one common source, so a node is visited once however many changes reach it.
    """
    t = V.tasks(spark, d).select("id", "target_path", "priority", "state")
    changed = t.where("priority = 1 AND state <> 'deleted'").select("id", "target_path")
    used_by = V.edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    source = spark.createDataFrame([(-1,)], "seed long")
    steps = used_by.unionByName(changed.select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst")))
    reached = reach(steps, source).where("depth > 0").select("node")
    dependent = used_by.join(reached.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
    at = changed.where("target_path IS NOT NULL").groupBy("target_path").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    specs = t.where("id % 3 = 0").select("id", "target_path")
    near = specs.join(at, "target_path").where((F.col("n") > 1) | (F.col("one") != F.col("id"))).select("id")
    why = changed.select("id", F.lit("changed").alias("reason")).union(near.select("id", F.lit("colocated"))).union(dependent.select("id", F.lit("depends"))).distinct()
    return specs.select("id").join(why, "id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("F8", P + """, u AS (SELECT kind, path, regexp_replace(signature, '[A-Za-z_$][A-Za-z0-9_$]*', '#', 'g') AS shape FROM x_symbols WHERE signature <> '' AND path IS NOT NULL)
SELECT kind, shape, count(*) AS n_units, count(DISTINCT path) AS n_files FROM u GROUP BY kind, shape HAVING count(DISTINCT path) >= 2""")
def templates_across_files(spark, d):
    """Units of the same shape, all names erased, in at least two files."""
    s = V.symbols(spark, d).where("signature <> '' AND path IS NOT NULL")
    shape = F.regexp_replace("signature", "[A-Za-z_$][A-Za-z0-9_$]*", "#")
    g = s.groupBy("kind", shape.alias("shape")).agg(F.count("*").alias("n_units"), F.count_distinct("path").alias("n_files"))
    return g.where("n_files >= 2")


_JUDGED = P + """, sites AS (SELECT DISTINCT name AS g, id AS site, path AS file, start_line AS line FROM x_symbols WHERE path IS NOT NULL AND name IS NOT NULL),
anchors AS (SELECT DISTINCT kind || tier AS item, CASE WHEN kind = 'class' THEN 'B' ELSE 'A' END AS cls, s.id AS anchor, s.path AS file, start_line AS low, end_line AS high FROM x_symbols s JOIN x_files f ON f.path = s.path WHERE tier IS NOT NULL AND kind IS NOT NULL),
touch AS (SELECT DISTINCT g, site, item, cls, anchor FROM sites s JOIN anchors a ON a.file = s.file AND s.line BETWEEN a.low AND a.high),
per AS (SELECT g, item, cls, count(DISTINCT anchor) AS covered, count(DISTINCT site) AS own FROM touch GROUP BY ALL),
st AS (SELECT p.*, (SELECT count(DISTINCT site) FROM sites s WHERE s.g = p.g) AS total, (SELECT count(DISTINCT site) FROM touch t WHERE t.g = p.g) - own AS foreign_, (SELECT count(DISTINCT anchor) FROM anchors a WHERE a.item = p.item) AS live FROM per p),
cr AS (SELECT *, CASE WHEN covered >= 2 AND own >= 0.25 * total AND foreign_ <= own THEN CASE WHEN foreign_ = 0 AND covered * 2 >= live THEN 1.0 ELSE 0.5 END ELSE 0.0 END AS credit FROM st)"""


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    s = V.symbols(spark, d).where("path IS NOT NULL")
    sites = s.where("name IS NOT NULL").select(F.col("name").alias("group_id"), F.col("id").alias("site"), F.col("path").alias("file"), F.col("start_line").alias("line"))
    tiers = V.files(spark, d).where("tier IS NOT NULL").select("path", "tier")
    anchors = s.where("kind IS NOT NULL").join(tiers, "path").select(
        F.concat("kind", "tier").alias("item_id"), F.when(F.col("kind") == "class", "B").otherwise("A").alias("class"), F.col("id").alias("anchor"), F.col("path").alias("file"),
        F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    return evidence.score_groups(sites, anchors), anchors


@query("M18", _JUDGED + " SELECT g AS group_id, item AS item_id, covered, own, foreign_ AS foreign_sites, CAST(credit AS DOUBLE) AS credit FROM cr")
def group_credit(spark, d):
    """Credit of groups (symbols of one name) for items (symbols of one kind and tier)."""
    return _judged(spark, d)[0].select("group_id", "item_id", "covered", "own", F.col("foreign").alias("foreign_sites"), "credit")


@query("A54", _JUDGED + """, v AS (SELECT g, coalesce(bool_or(cls = 'A' AND credit > 0), false) AS good, coalesce(bool_or(cls = 'B' AND covered >= 2), false) AS bad FROM cr GROUP BY g),
b AS (SELECT coalesce(sum(c), 0) AS credit FROM (SELECT max(credit) AS c FROM cr WHERE cls = 'A' GROUP BY item)), n AS (SELECT count(DISTINCT item) AS n_items FROM anchors WHERE cls = 'A')
SELECT n_items, CAST(credit AS DOUBLE) AS credit, CAST(credit AS DOUBLE) / nullif(n_items, 0) AS recall, (SELECT count(*) FROM v WHERE good) AS n_true, (SELECT count(*) FROM v WHERE NOT good AND bad) AS n_false,
(SELECT count(*) FILTER (good) * 1.0::DOUBLE / nullif(count(*) FILTER (good OR bad), 0) FROM v) AS precision FROM n, b""")
def group_scores(spark, d):
    """Recall and precision of the groups against the labelled items."""
    scored, anchors = _judged(spark, d)
    return evidence.score_summary(scored, anchors)


@query("M10", """WITH RECURSIVE """ + P.split("WITH RECURSIVE", 1)[1] + """, n AS (SELECT h.id, p.id AS up, coalesce(h.tier, '') AS l FROM x_tasks h LEFT JOIN x_tasks p ON p.id = h.parent_id AND h.parent_id <> 0),
t AS (SELECT id AS top, id FROM n UNION SELECT t.top, n.id FROM t JOIN n ON n.up = t.id), ok AS (SELECT id FROM n WHERE up IS NULL UNION ALL SELECT n.id FROM ok JOIN n ON n.up = ok.id)
SELECT t.top AS id, count(*) AS mass, count(*) FILTER (n.l <> '') AS n_anchors FROM t JOIN n ON n.id = t.id WHERE t.top IN (SELECT id FROM ok) GROUP BY t.top""")
def tree_masses(spark, d):
    """Fingerprinted task trees: mass and labels of every subtree. The digests themselves are tested on fixtures (tests/test_evidence.py)."""
    t = V.tasks(spark, d)
    nodes = t.select("id", N.id_key(F.col("parent_id")).alias("parent_id"), F.col("id").alias("place"), F.lit("task").alias("kind"), F.col("tier").alias("label"), F.lit(False).alias("is_name"), F.lit(False).alias("is_value"))
    return evidence.tree_fingerprints(nodes).select("id", "mass", "n_anchors")


QUERIES = family.queries
