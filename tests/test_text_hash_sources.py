from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from tidemark.functions import hashing as H
from tidemark.functions import normalize as N
from tidemark.functions import text as X
from tidemark.plans.relational import merge_scopes
from tidemark.plans.text import parse_duration
from tidemark.sources import records, scan, sqlguard, store


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize("raw,want", [(None, None), ("", None), (" ", None), ("@", None), (" @Ada-B\t", "ada-b"), ("ADA", "ada"), ("　 @x", "x")])
def test_handle_key(spark, raw, want):
    assert one(spark, raw, N.handle_key) == want


@pytest.mark.parametrize("raw,want", [("./a\\b//c.js ", "a/b/c.js"), ("A/b", "A/b"), (" ", None), (None, None), ("a/./b", "a/./b")])
def test_path_key(spark, raw, want):
    assert one(spark, raw, N.path_key) == want


@pytest.mark.parametrize("raw,want", [(None, None), (0, None), (1_700_000_000, 1_700_000_000_000), (1_700_000_000_123, 1_700_000_000_123), (-5, -5000)])
def test_instant(spark, raw, want):
    assert one(spark, raw, N.instant_ms, "long") == want


@pytest.mark.parametrize("raw,want", [(None, False), ("  　​⁠﻿­\n", False), (" a", True), ("​.", True)])
def test_visible(spark, raw, want):
    assert one(spark, raw, N.visible) is want


@pytest.mark.parametrize("x,want", [(-2.5, -2), (2.5, 3), (0.49, 0)])
def test_js_round(spark, x, want):
    assert one(spark, x, N.js_round, "double") == want


@pytest.mark.parametrize("raw,want", [("getHTTPServerName", ["get", "http", "server", "name"]), ("snake_case-kebab.path/x", ["snake", "case", "kebab", "path"]), ("a", []), ("", []), (None, [])])
def test_subwords(spark, raw, want):
    assert one(spark, raw, X.subwords) == want


def test_query_terms_keep_stop_words_only_if_alone(spark):
    assert one(spark, "the cursor of an index", X.query_terms) == ["cursor", "index"]
    assert one(spark, "of the", X.query_terms) == ["of", "the"]


@pytest.mark.parametrize("raw,want", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1)])
def test_line_count(spark, raw, want):
    assert one(spark, raw, X.line_count) == want


def test_matches_escape_and_clamp(spark):
    assert one(spark, "a.b a+b A.B", lambda c: X.matches_of(c, "a.b")) == ["a.b"]
    assert one(spark, "a.b A.B", lambda c: X.matches_of(c, "a.b", ignore_case=True)) == ["a.b", "A.B"]
    assert one(spark, "x" * 1005, X.clamp_line).endswith("… (+5)") and one(spark, "x", X.clamp_line) == "x"
    assert one(spark, "  Hello, World! ", X.slug) == "hello-world"


KEY = "ghp_" + "a" * 36


@pytest.mark.parametrize("line,want", [(f'k = "{KEY}"', True), (f"k = '{KEY}'", True), (f"k = \"{KEY}'", False), (f'// "{KEY}"', False), (f'k = "{KEY}" // dummy', False), (f'process.env.X || "{KEY}"', False), (KEY, False), ('"AKIA' + "A" * 16 + '"', True)])
def test_secrets(spark, line, want):
    assert one(spark, line, X.is_secret_line) is want


@pytest.mark.parametrize("line,want", [
    ('<img src="a.png">', ["A11Y_IMAGE_MISSING_ALT"]), ('<img alt="" src="a">', []), ('<div @click="f">', ["A11Y_CLICKABLE_NON_SEMANTIC"]), ('<div role="button" @click="f">', []),
    ('<a href="x" target="_blank">', ["SECURITY_REVERSE_TABNABBING"]), ('<a target="_blank" rel="noopener">', []), ('<a href="javascript:f()">', ["SECURITY_JAVASCRIPT_URL"]),
    ('<p v-html="x">', ["SECURITY_RAW_HTML_INJECTION"]), ('<p v-html="sanitize(x)">', []),
])
def test_html_rules(spark, line, want):
    assert one(spark, line, X.html_rules) == want


@pytest.mark.parametrize("line,want", [("expect(true).toBe(true)", True), ("expect(true).toBe(false)", False), ("assert.equal(1, 1)", True), ("assert True", True), ("// assert True", False), ("assert x == 1", False), ("self.assertTrue(True)", True)])
def test_fake_green(spark, line, want):
    assert one(spark, line, X.is_fake_green) is want


@pytest.mark.parametrize("line,want", [
    ("// I hope this helps", "residue"), ('s = "hope this helps"', None), ("it's // hope this helps", None), ("# it's what I hope this helps", "residue"),
    ("// ... rest of code", "truncation"), ("```js", "fence"), ("Here is the updated code", "preamble"), ("replace with your own", "placeholder"), ("plain", None), ("a \\\" hope this helps", "residue"),
])
def test_residue(spark, line, want):
    assert one(spark, line, X.residue_kind) == want


@pytest.mark.parametrize("p,want", [("a+b", None), ("(?=a)", "lookaround"), ("(?<!a)", "lookaround"), (r"(a)\1", "back-reference"), ("[(?=]", None), ("(a", "unbalanced parenthesis"), ("a)", "unbalanced parenthesis"), ("[a", "unbalanced class"), ("a\\", "trailing backslash"), ("(?:a|b)", None)])
def test_regex_guard(p, want):
    assert X.regex_problem(p) == want


def test_hashes_against_known_values(spark):
    assert H.fnv1a("") == 0x811C9DC5 and H.fnv1a("a") == 0xE40C292C and H.fnv1a("foobar") == 0xBF9CF968
    assert H.murmur3_units("") == 0 and H.utf16_units("a😀") == [0x61, 0xD83D, 0xDE00]
    assert len(H.digest64("x")) == 16 and H.digest64("x") != H.digest64("y")
    v = H.feature_vector("getName")
    assert abs(float((v**2).sum()) - 1) < 1e-6 and not H.feature_vector("").any() and not H.feature_vector(None).any()
    df = spark.createDataFrame([("foobar",), (None,)], "c string").select(H.fnv1a_udf("c").alias("h"), H.feature_vector_udf("c").alias("v"), H.digest64_udf("c").alias("d"))
    assert rows(df.select("h", "d")) == sorted([(0xBF9CF968, H.digest64("foobar")), (None, None)], key=repr)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(H.cosine_unit(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_scopes_and_durations():
    assert merge_scopes(["a/b", "c"], ["a", "cd"]) == ["a", "c", "cd"]
    assert [parse_duration(x) for x in ("30s", "5m", "1h", "250ms")] == [30_000, 300_000, 3_600_000, 250]
    with pytest.raises(ValueError):
        parse_duration("soon")


# ---- sources


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.js").write_bytes(b"export function f() {}\r\nconst x = g(1)\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "src" / "node_modules" / "c.js").write_text("x")
    (tmp_path / "src" / "skip.md").write_text("x")
    return tmp_path


def test_scan_tree(spark, tree):
    got = scan.scan_tree(spark, str(tree), ["src", "."], ["**/*.md"])
    assert rows(got.select("path", "kind")) == [("src/a.js", "text"), ("src/b.bin", "binary")]
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND"):
        scan.scan_tree(spark, str(tree), ["missing"]).collect()


def test_lines_symbols_calls_and_engines(spark, tree):
    ls = scan.read_lines(spark, str(tree / "src" / "a.js"))
    assert [r["text"] for r in ls.orderBy("line").collect()] == ["export function f() {}", "const x = g(1)", ""]
    assert rows(scan.extract_symbols(ls).select("kind", "name", "is_export")) == [("function", "f", True), ("symbol", "x", False)]
    assert ("g",) in rows(scan.extract_calls(ls).select("callee"))
    for engine in ("native", "datasource"):
        assert [r["line"] for r in scan.literal_search(spark, str(tree / "src"), "g(1", engine=engine).collect()] == [2]
    with pytest.raises(ValueError, match="unknown engine"):
        scan.literal_search(spark, "x", "y", engine="none")


def test_engines_read_large_files_whole(spark, tmp_path):
    text = "return null\n" + "x" * 99 + "\0\n" + ("y" * 99 + "\r\n") * 90_000 + "return null"
    (tmp_path / "part-0").write_bytes(text.encode())
    assert len(text) > scan.LARGE_BYTES
    for engine in ("native", "datasource"):
        assert sorted(r["line"] for r in scan.literal_search(spark, str(tmp_path), "return null", engine=engine).collect()) == [1, 90_003]


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n", "\n\n", "ab\r\ncd\n\nefghij\r\r\nk", "abc\nde\r\n"])
def test_byte_ranges_make_up_the_file(tmp_path, monkeypatch, text):
    path = tmp_path / "part-0"
    path.write_bytes(text.encode())
    want = [(str(path), i, x) for i, x in enumerate(re.split("\r?\n", text), 1)]
    for size in (1, 2, 3, 4, 100):
        monkeypatch.setattr(scan, "RANGE_BYTES", size)
        reader = scan._LiteralReader({"path": str(tmp_path), "pattern": ""})
        assert [x for p in reader.partitions() for x in reader.read(p)] == want


def test_jsonl(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"kind":"a","n":1}\n\n{"kind":"b"\n{"kind":"c","n":3}\n')
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])
    assert rows(records.read_jsonl(spark, str(p), schema).where("kind IS NOT NULL AND n IS NOT NULL")) == [("a", 1), ("c", 3)]
    good, counts = records.read_jsonl_counted(spark, str(p), schema)
    assert good.count() == 2 and tuple(counts.first()) == (2, 1)
    records.append_jsonl(good, str(tmp_path / "out"))
    records.append_jsonl(good, str(tmp_path / "out"))
    assert spark.read.schema(schema).json(str(tmp_path / "out")).count() == 4


def test_run_folder(spark, tmp_path):
    (tmp_path / "agent-1.jsonl").write_text('{"n":1}\n{"n":2}\n')
    (tmp_path / "agent-2.jsonl").write_text('{"n":5}\n')
    (tmp_path / "agent-1.meta.json").write_text('{\n"label": "build"}\n')
    entry, meta = T.StructType([T.StructField("n", T.LongType())]), T.StructType([T.StructField("label", T.StringType())])
    got = records.read_run(spark, str(tmp_path), entry, meta)
    assert sorted((r["agent"], r["n"], r["label"]) for r in got.collect()) == [("1", 1, "build"), ("1", 2, "build"), ("2", 5, None)]


def test_export_cursor(spark, tmp_path):
    df = spark.createDataFrame([(1, "k", "a\nb"), (2, "k", "c")], "at long, kind string, note string")
    cursor, out = str(tmp_path / "cursor.json"), str(tmp_path / "md")
    assert records.export_since(df, "at", cursor, out) == 2 and records.export_since(df, "at", cursor, out) == 0
    assert json.load(open(cursor)) == {"cursor": 2}
    assert rows(spark.read.text(out)) == [("- k: a b",), ("- k: c",)]


def test_federated_and_discover(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    spark.range(2).selectExpr("id AS a").write.parquet(str(tmp_path / "x" / "ledger"))
    frame, errors = records.federated(spark, {"x": str(tmp_path / "x" / "ledger"), "y": str(tmp_path / "none")}, schema)
    assert rows(frame) == [("x", 0, None), ("x", 1, None)] and [e[0] for e in errors] == ["y"]
    assert records.discover(str(tmp_path), "ledger") == [str(tmp_path / "x" / "ledger")]


def test_columnar(spark):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    wire = records.to_columnar(df, 10, {"s": F.upper("s")})
    assert wire == {"cols": ["n", "s"], "rows": [[1, "A"]]}
    assert rows(records.from_columnar(spark, {"cols": ["n", "s"], "rows": [[1, "A"], [2]]}, df.schema)) == [(1, "A"), (2, None)]


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    new = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    store.replace_keys(spark, path, new(("a", 1), ("a", 2), ("b", 3)), ["k"])
    store.replace_keys(spark, path, new(("a", 9)), ["k"])
    assert rows(spark.read.parquet(path)) == [("a", 9), ("b", 3)]
    store.delete_keys(spark, path, new(("b", 0)), ["k"])
    assert rows(spark.read.parquet(path)) == [("a", 9)]
    assert [f for f in os.listdir(tmp_path) if f.startswith("t.")] == []
    parts = str(tmp_path / "p")
    store.replace_partitions(new(("a", 1), ("b", 2)), parts, ["k"])
    store.replace_partitions(new(("a", 7)), parts, ["k"])
    assert rows(spark.read.parquet(parts).select("k", "v")) == [("a", 7), ("b", 2)]
    assert rows(store.latest(new(("a", 1), ("a", 5), ("b", 2)), ["k"], [F.desc("v")])) == [("a", 5), ("b", 2)]
    calls = []
    build = lambda: (calls.append(1), new(("z", 1)))[1]
    assert store.cached(spark, str(tmp_path), "key", build).count() == store.cached(spark, str(tmp_path), "key", build).count() == 1 and len(calls) == 1
    assert rows(store.structure(new(("a", 1)))) == [(0, "k", "string", True), (1, "v", "bigint", True)]
    assert rows(store.browse(new(*[("a", i) for i in range(5)]), "v", 2, 2)) == [("a", 2), ("a", 3)]
    assert store.page_envelope(7, 3, 3, 3) == {"total": 7, "page": 2, "hasMore": True, "nextOffset": 6}
    new(("a", 1)).createOrReplaceTempView("some_view")
    assert ("some_view", "TEMPORARY", 1) in rows(store.tables(spark))


def test_sync_plan(spark):
    s = spark.createDataFrame([("same", 0, 1, 90_000), ("racy", 89_000, 1, 90_000), ("edited", 5, 1, 90_000), ("gone", 5, 1, 90_000)], "path string, mtime long, size long, synced_at long")
    n = spark.createDataFrame([("same", 0, 1), ("racy", 89_000, 1), ("edited", 6, 1), ("new", 1, 1)], "path string, mtime long, size long")
    assert dict(tuple(r) for r in store.sync_plan(s, n).collect()) == {"same": "same", "racy": "check", "edited": "changed", "gone": "remove", "new": "add"}


@pytest.mark.parametrize("sql,ok", [
    ("SELECT 1", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True), ("VALUES (1)", True), ("SHOW TABLES", True), ("DROP TABLE x", False), ("INSERT INTO x VALUES (1)", False),
    ("SELECT 1; DROP TABLE x", False), ("CREATE TABLE y AS SELECT 1", False), ("SET a=b", False), ("SELECT * FROM parquet.`/etc`", False), ("SELECT (SELECT max(a) FROM csv.`/x`)", False),
    ("EXECUTE IMMEDIATE 'DROP TABLE x'", False), ("SELECT java_method('a','b')", False), ("", False), ("selec 1", False), ("BEGIN SELECT 1; END", False), ("-- note\nSELECT 'DROP TABLE'", True),
])
def test_sql_guard(spark, sql, ok):
    assert (sqlguard.refusal(spark, sql) is None) is ok


def test_read_only_sql(spark):
    assert sqlguard.read_only_sql(spark, "SELECT * FROM range(500)").count() == 100
    with pytest.raises(ValueError, match="not a query"):
        sqlguard.read_only_sql(spark, "DROP TABLE x")
