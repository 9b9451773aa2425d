"""Text, JSON and vector queries over documents, posts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import normalize as N
from tidemark.functions import text as X
from tidemark.operators import search
from tidemark.operators.windows import last_n
from tidemark.plans import views as V
from tidemark.plans.registry import Family
from tidemark.runtime import load

family = Family()
query = family.query
P = V.PRELUDE
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query("X3", P + """SELECT id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE w END, ' ') AS terms FROM (SELECT id, w, list_filter(w, lambda x: x NOT IN ('a','an','the','in','on','at','to','for','of','with','by','from','as','into','is','are','was','were','it','its','or','and','be','been','this','that','these','those','then')) AS kept FROM (
SELECT id, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(title, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[-_./\\\\]+', ' ', 'g')), '\\s+'), lambda x: length(x) > 1) AS w FROM x_tasks WHERE title IS NOT NULL))""")
def query_terms(spark, d):
    return V.tasks(spark, d).where("title IS NOT NULL").select("id", F.array_join(X.query_terms(F.col("title")), " ").alias("terms"))


@query("X4 X5 X6", f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM w),
p AS (SELECT doc_id, term, any_value(length) AS length, count(*) AS tf FROM e GROUP BY doc_id, term), l AS (SELECT count(*) AS n, avg(length) AS m FROM (SELECT doc_id, any_value(length) AS length FROM e GROUP BY doc_id)),
h AS (SELECT * FROM p WHERE term IN ('cursor', 'snapshot', 'warns')), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 6) AS score FROM h JOIN f ON f.term = h.term, l GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_search(spark, d):
    docs = load(spark, d, "documents").where("text IS NOT NULL")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    found = search.bm25(search.postings(docs, "doc_id", words), "doc_id", ["cursor", "snapshot", "warns"])
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("X7 X10 S6", P + "SELECT doc_id, line, CASE WHEN length(text) > 80 THEN left(text, 80) || '… (+' || (length(text) - 80) || ')' ELSE text END AS clamped FROM x_lines WHERE contains(lower(text), 'price table')")
def literal_search(spark, d):
    return V.lines(spark, d).where(F.lower("text").contains("price table")).select("doc_id", "line", X.clamp_line(F.col("text"), 80).alias("clamped"))


@query("X8 U8 X9", P + "SELECT DISTINCT m FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+_[a-z]+')) AS m FROM x_lines)")
def regex_search(spark, d, pattern: str = "[a-z]+_[a-z]+"):
    """All distinct texts that a pattern matches; a pattern without linear-time matching is refused."""
    if problem := X.regex_problem(pattern):
        raise ValueError(problem)
    return V.lines(spark, d).select(F.explode(X.matches_of(F.col("text"), pattern, is_regex=True)).alias("m")).distinct()


@query("X11", "SELECT doc_id, replace(text, 'old snapshot', 'new snapshot') AS text, (length(text) - length(replace(text, 'old snapshot', ''))) // 12 AS n FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents WHERE contains(text, 'old snapshot'))")
def literal_replace(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").contains("old snapshot")).withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n")))
    return docs.select("doc_id", F.replace("text", F.lit("old snapshot"), F.lit("new snapshot")).alias("text"), X.occurrences_of(F.col("text"), "old snapshot").cast("long").alias("n"))


@query("X12 X13", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS n_lines, CASE WHEN strpos(text, 'column') > 0 THEN length(left(text, strpos(text, 'column') - 1)) - length(replace(left(text, strpos(text, 'column') - 1), chr(10), '')) + 1 END AS hit_line FROM documents WHERE text IS NOT NULL")
def line_metrics(spark, d):
    at = F.instr("text", "column") - 1
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.line_count(F.col("text")).cast("long").alias("n_lines"), F.when(at >= 0, X.line_of(F.col("text"), at)).cast("long").alias("hit_line"))


@query("X15", P + """SELECT doc_id, line FROM x_lines WHERE (regexp_matches(text, '''(sk-[a-zA-Z0-9_-]{24,}|ghp_[a-zA-Z0-9]{30,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35})''') OR regexp_matches(text, '"(sk-[a-zA-Z0-9_-]{24,}|ghp_[a-zA-Z0-9]{30,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35})"'))
AND NOT regexp_matches(text, '^\\s*(//|#|\\*|--|/\\*|<!--)') AND NOT contains(text, 'process.env') AND NOT contains(text, 'import.meta.env') AND NOT contains(text, 'dummy') AND NOT contains(text, 'placeholder')""")
def secret_scan(spark, d):
    return V.lines(spark, d).where(X.is_secret_line(F.col("text"))).select("doc_id", "line")


@query("X16")
def html_hygiene(spark, d):
    """Template rules broken per line. The patterns look ahead, so the oracle engine cannot run them; tested on a fixture."""
    return V.lines(spark, d).select("doc_id", "line", F.explode(X.html_rules(F.col("text"))).alias("rule"))


@query("X17")
def fake_green_scan(spark, d):
    """Assertions of a literal against itself. The patterns have back-references, so there is no oracle; tested on a fixture."""
    return V.lines(spark, d).where(X.is_fake_green(F.col("text"))).select("doc_id", "line")


@query("X18")
def residue_scan(spark, d):
    """Assistant residue outside string literals. The quote state has no oracle; tested on a fixture."""
    return V.lines(spark, d).select("doc_id", "line", X.residue_kind(F.col("text")).alias("kind")).where("kind IS NOT NULL")


@query("X19 X20")
def echo_lines(spark, d):
    """Comments of two to six words of which three quarters or more occur in the next line."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line")
    rows = V.lines(spark, d).withColumn("next", F.lead("text").over(w)).where(F.trim("text").startswith("//") & ~F.trim("text").startswith("///"))
    words, code = X.comment_words(F.regexp_replace(F.trim("text"), r"^//\s*", "")), X.comment_words(F.coalesce("next", F.lit("")))
    shared = F.size(F.filter(words, lambda x: F.array_contains(code, x)))
    return rows.where(F.size(words).between(2, 6) & (shared >= 0.75 * F.size(words))).select("doc_id", "line")


@query("X21", P + """, a AS (SELECT doc_id, line, regexp_extract(text, 'allow:\\s*([A-Z_]+)', 1) AS rule FROM x_lines WHERE regexp_matches(text, 'allow:\\s*[A-Z_]+'))
SELECT l.doc_id, l.line FROM x_lines l WHERE contains(l.text, 'return null') AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = l.doc_id AND a.rule = 'SILENT_GUARD' AND a.line IN (l.line, l.line - 1))""")
def suppressed_findings(spark, d):
    """Findings that no allow annotation on their line or the line before takes back."""
    ls = V.lines(spark, d)
    allowed = ls.where(F.regexp_extract("text", r"allow:\s*([A-Z_]+)", 1) == "SILENT_GUARD").select("doc_id", F.explode(F.array("line", F.col("line") + 1)).alias("line"))
    return ls.where(F.col("text").contains("return null")).join(allowed, ["doc_id", "line"], "left_anti").select("doc_id", "line")


@query("X22", P + "SELECT id, CASE WHEN lower(signature) LIKE '%header%' THEN 'header' WHEN lower(signature) LIKE '%window%' THEN 'window' WHEN lower(signature) LIKE '%queue%' THEN 'list' WHEN signature = '' THEN 'none' ELSE 'other' END AS category FROM x_symbols WHERE signature IS NOT NULL")
def structure_categories(spark, d):
    s = F.lower("signature")
    cat = F.when(s.contains("header"), "header").when(s.contains("window"), "window").when(s.contains("queue"), "list").when(s == "", "none").otherwise("other")
    return V.symbols(spark, d).where("signature IS NOT NULL").select("id", cat.alias("category"))


@query("X23", P + "SELECT DISTINCT id, unnest(regexp_extract_all(message, '[A-Za-z0-9_-]+(?:/[A-Za-z0-9_.-]+)+\\.[a-z]+')) AS file FROM x_feed WHERE message IS NOT NULL")
def file_mentions(spark, d):
    return V.feed(spark, d).select("id", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"[A-Za-z0-9_-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z]+"), F.lit(0)))).alias("file"))


@query("X24 X25 X26 X30", P + """SELECT id, CASE WHEN regexp_replace(trim(agent), '^@+', '') <> '' THEN '@' || regexp_replace(trim(agent), '^@+', '') END AS handle, coalesce(CASE verb WHEN 'q' THEN 'query' WHEN 'p' THEN 'pattern' END, verb) AS verb,
regexp_replace(regexp_replace(lower(action), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, TRY_CAST(nullif(regexp_extract(session, '^s0*([0-9]+)', 1), '') AS BIGINT) AS session_no FROM x_calls""")
def normalise_handles(spark, d):
    """Handles, action names by an alias map, slugs and the leading number of a session."""
    alias = F.create_map(F.lit("q"), F.lit("query"), F.lit("p"), F.lit("pattern"))
    number = F.regexp_extract("session", "^s0*([0-9]+)", 1)
    return V.calls(spark, d).select(
        "id", X.at_handle(F.col("agent")).alias("handle"), F.coalesce(alias[F.col("verb")], F.col("verb")).alias("verb"), X.slug(F.col("action")).alias("slug"),
        F.when(number != "", number.cast("long")).alias("session_no"))


@query("X27 X28", P + "SELECT model, CASE WHEN model ILIKE '%large%' THEN 'big' WHEN model ILIKE '%mid%' THEN 'middle' WHEN model ILIKE '%small%' THEN 'little' ELSE 'unknown' END AS family, count(*) AS n FROM x_usage GROUP BY ALL")
def model_families(spark, d):
    m = F.col("model")
    fam = F.when(m.rlike("(?i)large"), "big").when(m.rlike("(?i)mid"), "middle").when(m.rlike("(?i)small"), "little").otherwise("unknown")
    return V.usage(spark, d).groupBy("model", fam.alias("family")).agg(F.count("*").alias("n"))


@query("X29", "SELECT doc_id, CAST(regexp_extract(text, '## ([0-9]+)\\.([0-9]+)\\.([0-9]+)', 1) AS BIGINT) AS major, CAST(regexp_extract(text, '## ([0-9]+)\\.([0-9]+)\\.([0-9]+)', 3) AS BIGINT) + 1 AS next_patch FROM documents WHERE regexp_matches(text, '## [0-9]+\\.[0-9]+\\.[0-9]+')")
def next_versions(spark, d):
    p = r"## ([0-9]+)\.([0-9]+)\.([0-9]+)"
    part = lambda i: F.regexp_extract("text", p, i).cast("long")
    return load(spark, d, "documents").where(F.col("text").rlike(p)).select("doc_id", part(1).alias("major"), (part(3) + 1).alias("next_patch"))


@query("X31", P + "SELECT doc_id, line, split_part(trim(substr(text, 3)), ' ', 1) AS program, split_part(trim(substr(text, 3)), ' ', 2) AS verb FROM x_lines WHERE starts_with(text, '$ ')")
def shell_commands(spark, d):
    """Program and verb of shell lines."""
    words = F.split(F.trim(F.substr("text", F.lit(3))), " ")
    return V.lines(spark, d).where(F.col("text").startswith("$ ")).select("doc_id", "line", words[0].alias("program"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("verb"))


# ---- JSON and arrays


@query("N2 G19 R60", P + """, d AS (SELECT id, unnest(CAST(json(dependencies) AS BIGINT[])) AS dep FROM x_tasks WHERE json_valid(dependencies))
SELECT d.id, d.dep, coalesce(t.state IN ('done', 'duplicate', 'cancelled'), false) AS is_met FROM d LEFT JOIN x_tasks t ON t.id = d.dep""")
def dependency_satisfied(spark, d):
    """Whether each listed dependency is closed; a missing one is not."""
    t = V.tasks(spark, d)
    deps = t.select("id", F.explode(F.from_json("dependencies", "array<bigint>")).alias("dep"))
    state = t.select(F.col("id").alias("dep"), "state")
    return deps.join(state, "dep", "left").select("id", "dep", F.coalesce(F.col("state").isin("done", "duplicate", "cancelled"), F.lit(False)).alias("is_met"))


@query("N1 N3 N4", P + "SELECT id, CASE WHEN json_valid(metadata) THEN CAST(coalesce(json_extract_string(metadata, '$.run'), json_extract_string(metadata, '$.archived')) AS BIGINT) END AS value, coalesce(json_valid(metadata), false) AS is_valid FROM x_feed")
def json_paths(spark, d):
    valid = F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNotNull()
    value = F.coalesce(F.get_json_object("metadata", "$.run"), F.get_json_object("metadata", "$.archived")).cast("long")
    return V.feed(spark, d).select("id", F.when(valid, value).alias("value"), valid.alias("is_valid"))


@query("N5", "SELECT json_structure(props)::VARCHAR LIKE '%k%' AS has_k, count(*) AS n FROM events GROUP BY 1")
def json_shapes(spark, d):
    shape = F.schema_of_variant(F.try_parse_json("props"))
    return load(spark, d, "events").groupBy(shape.contains("k:").alias("has_k")).agg(F.count("*").alias("n"))


@query("N6 A46", P + "SELECT capability, count(*) AS n FROM (SELECT unnest(CAST(json(capabilities) AS VARCHAR[])) AS capability FROM x_agents WHERE json_valid(capabilities)) GROUP BY capability")
def explode_nested(spark, d):
    caps = F.explode(F.from_json("capabilities", "array<string>")).alias("capability")
    return V.agents(spark, d).select(caps).groupBy("capability").agg(F.count("*").alias("n"))


@query("R33", P + "SELECT id FROM x_agents WHERE json_valid(capabilities) AND list_contains(CAST(json(capabilities) AS VARCHAR[]), 'claim')")
def crew_listing(spark, d):
    return V.agents(spark, d).where(F.array_contains(F.from_json("capabilities", "array<string>"), "claim")).select("id")


@query("N7", P + "SELECT run_id, agent_key, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS plain, coalesce(cache_write_5m_tokens, 0) + coalesce(cache_write_1h_tokens, 0) AS cached, greatest(coalesce(total_tokens, 0) - coalesce(cache_read_tokens, 0), 0) AS net FROM x_usage")
def usage_arithmetic(spark, d):
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return V.usage(spark, d).select(
        "run_id", "agent_key", (z("input_tokens") + z("output_tokens")).alias("plain"), (z("cache_write_5m_tokens") + z("cache_write_1h_tokens")).alias("cached"),
        F.greatest(z("total_tokens") - z("cache_read_tokens"), F.lit(0)).alias("net"))


PACK_ROWS = 1000


@query("N8 N9 N11 P1")
def context_pack(spark, d):
    """Files with their symbols as nested arrays, in parts of about PACK_ROWS symbols, and the number of open tasks on them.

    A file may hold a third of all symbols, so its symbols are dealt out to as many parts as they need (part from 0).
    """
    s = V.symbols(spark, d).where("path IS NOT NULL").select("path", "start_line", "id", "name")
    parts = s.groupBy("path").agg(F.ceil(F.count("*") / PACK_ROWS).alias("n_parts"))
    dealt = s.join(parts, "path").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")))
    packed = dealt.groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "name"))).alias("symbols"))
    t = V.tasks(spark, d).where("target_path IS NOT NULL").groupBy(F.col("target_path").alias("path")).agg(F.count_if(~F.col("state").isin(V.CLOSED)).alias("n_open"))
    return V.files(spark, d).select("path", "tier").join(packed, "path", "left").join(t, "path", "left")


@query("N10", P + "SELECT path, '{' || string_agg('\"' || kind || '\":' || n, ',' ORDER BY kind) || '}' AS kinds FROM (SELECT path, kind, count(*) AS n FROM x_symbols WHERE path IS NOT NULL GROUP BY path, kind) GROUP BY path")
def sorted_kinds(spark, d):
    """Counts by kind as JSON with sorted keys."""
    n = V.symbols(spark, d).where("path IS NOT NULL").groupBy("path", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("path").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("kinds"))


@query("N12", P + "SELECT parent_id, target_path, count(*) AS n FROM x_tasks WHERE parent_id IS NOT NULL AND target_path IS NOT NULL GROUP BY parent_id, target_path HAVING count(*) > 1")
def shared_targets(spark, d):
    """Files that several children of one task claim."""
    t = V.tasks(spark, d).where("parent_id IS NOT NULL AND target_path IS NOT NULL")
    return t.groupBy("parent_id", "target_path").agg(F.count("*").alias("n")).where("n > 1")


# ---- hashes and vectors


@query("M1 M2")
def feature_hash(spark, d):
    """Feature-hash vectors of symbol names. 32-bit wrap-around has no oracle; tested against a plain model."""
    s = V.symbols(spark, d).where("name IS NOT NULL").select("name").distinct()
    return s.select("name", H.fnv1a_udf("name").alias("fnv"), H.feature_vector_udf("name").alias("vector"))


@query("M8 M9")
def unit_digests(spark, d):
    """Digests of symbol names, each distinct name hashed once. No oracle; tested against known values."""
    return V.symbols(spark, d).where("name IS NOT NULL").select("name").distinct().select("name", H.digest64_udf("name").alias("digest"))


@query("M3 M4", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])), 5) AS cosine FROM embeddings WHERE list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) >= 0.2")
def cosine_filter(spark, d, probe: int = 3):
    e = V.vectors(spark, d)
    q = F.broadcast(e.where(F.col("vec_id") == probe).select(F.col("embedding").alias("q")).limit(1))  # a single row
    return e.crossJoin(q).select("vec_id", F.round(H.cosine_unit(F.col("embedding"), F.col("q")), 5).alias("cosine")).where(F.col("cosine") >= 0.2)


@query("M7 S21 R5", "SELECT sha1(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark, d):
    g = load(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha1("text").alias("digest"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


SET_SQL = "md5(count(*) || ':' || sum(CAST('0x' || left(md5({0}), 12) AS BIGINT)))"


def set_digest(key):
    """Digest of a group's distinct keys that does not depend on their order and collects none: count and sum of their hashes."""
    part = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("decimal(38,0)")
    return F.md5(F.concat_ws(":", F.count("*").cast("string"), F.sum(part).cast("string")))


@query("M11", P + "SELECT name, " + SET_SQL.format("k") + " AS group_id FROM (SELECT DISTINCT name, path || ':' || start_line AS k FROM x_symbols WHERE name IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL) GROUP BY name HAVING count(*) > 1")
def group_ids(spark, d):
    """Content id of a group from its member keys, equal under any order of members."""
    s = V.symbols(spark, d).where("name IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL").select("name", F.concat_ws(":", "path", "start_line").alias("k")).distinct()
    return s.groupBy("name").agg(set_digest(F.col("k")).alias("group_id"), F.count("*").alias("n")).where("n > 1").select("name", "group_id")


@query("M12", P + "SELECT id, round(list_sum(list_transform(string_split(path, '/'), lambda x: 1.0 / length(x))), 6) AS weight FROM x_symbols WHERE path IS NOT NULL")
def anchor_weights(spark, d):
    """Sum of part weights of a path; short parts weigh more."""
    w = F.aggregate(F.transform(F.split("path", "/"), lambda x: 1.0 / F.length(x)), F.lit(0.0), lambda s, x: s + x)
    return V.symbols(spark, d).where("path IS NOT NULL").select("id", F.round(w, 6).alias("weight"))


@query("D4 D5 D6", P + "SELECT run_id, agent_key, ended - began AS wall_ms, strftime(make_timestamp(began * 1000), '%Y-%m-%dT%H:%M:%S') AS started, CASE WHEN began < 1766000000000 THEN 'before' WHEN ended > 1770000000000 THEN 'after' ELSE 'inside' END AS coverage FROM x_usage WHERE began IS NOT NULL AND ended IS NOT NULL")
def run_times(spark, d):
    u = V.usage(spark, d).where("began IS NOT NULL AND ended IS NOT NULL")
    started = F.date_format(F.timestamp_millis("began"), "yyyy-MM-dd'T'HH:mm:ss")
    where = F.when(F.col("began") < 1_766_000_000_000, "before").when(F.col("ended") > 1_770_000_000_000, "after").otherwise("inside")
    return u.select("run_id", "agent_key", (F.col("ended") - F.col("began")).alias("wall_ms"), started.alias("started"), where.alias("coverage"))


def parse_duration(text: str) -> int:
    """Milliseconds of a duration such as 250ms, 30s, 5m or 1h."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}[m[2]]


@query("D9", P + "SELECT count(*) AS n FROM x_feed WHERE moment >= (SELECT max(moment) FROM x_feed) - 36 * 3600000")
def within_duration(spark, d, span: str = "36h"):
    """Posts within a duration before the latest one."""
    f = V.feed(spark, d).where("at IS NOT NULL").select("at")
    last = F.broadcast(f.agg(F.max("at").alias("last")))  # a single row
    return f.join(last, F.col("at") >= F.col("last") - parse_duration(span)).agg(F.count("*").alias("n"))


QUERIES = family.queries
