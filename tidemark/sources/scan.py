"""Scans of source trees, lines and literal matches, with pluggable engines."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

import tidemark.runtime  # noqa: F401  lets the data source travel to workers

#: Folders that a scan leaves out at any depth, those it leaves out at the top only, and how much of a file decides about it.
IGNORED_DIRS = [
    "node_modules", ".git", "vendor", "dist", "coverage", ".claude", ".cursor", ".gemini", ".agents", ".next", ".turbo", ".output", ".nuxt", ".cache",
    ".svelte-kit", ".pnpm-store", ".yarn",
]
ROOT_ONLY_DIRS = ["build", "out", "temp", "tmp", "scratch", "benchmarks", "blueprints"]
SNIFF_BYTES = 8000
LARGE_BYTES = 8 * 1024 * 1024
#: Bytes of a file that one task of the data source reads.
RANGE_BYTES = 16 * 1024 * 1024


def is_ignored(path: Column, root_only: list[str] | None = None) -> Column:
    """Whether a relative path lies in an ignored folder; ``root_only`` folders (by default ROOT_ONLY_DIRS) count at the top level only."""
    anywhere = path.rlike("(^|/)(" + "|".join(re.escape(d) for d in IGNORED_DIRS) + ")/")
    for d in ROOT_ONLY_DIRS if root_only is None else root_only:
        anywhere = anywhere | path.startswith(d + "/")
    return anywhere


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: ** any folders, * within one, ? one character."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def scan_tree(spark: SparkSession, root: str, scopes: list[str] | None = None, exclude: list[str] | None = None, root_only: list[str] | None = None) -> DataFrame:
    """Files below the scopes of a root: path (relative), mtime, size, kind (text, binary or large).

    A scope that does not exist is an error, not an empty result. Overlapping scopes give each file once. Ignored folders and
    ``exclude`` globs are left out. Contents are read for the first bytes only where the kind needs them.
    """
    base = root.rstrip("/")
    paths = [f"{base}/{s}" if s not in (".", "") else base for s in scopes or ["."]]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    relative = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(base.lstrip("/")) + "/", "")
    kind = F.when(F.col("length") > LARGE_BYTES, "large").when(F.instr(F.decode(F.substring("content", 1, SNIFF_BYTES), "ISO-8859-1"), "\x00") > 0, "binary").otherwise("text")
    out = files.select(relative.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), kind.alias("kind"))
    out = out.where(~is_ignored(F.col("path"), root_only))
    for g in exclude or []:
        out = out.where(~F.col("path").rlike(glob_pattern(g)))
    return out.dropDuplicates(["path"])


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files: path, line (from 1), text; CRLF counts as one break."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


# ---- pluggable literal engines

Engine = Callable[[SparkSession, str, str, bool], DataFrame]
_ENGINES: dict[str, Engine] = {}


def register_engine(name: str, search: Engine) -> None:
    """Make a scan engine known by name; a later one of the same name replaces it."""
    _ENGINES[name] = search


def literal_search(spark: SparkSession, path: str, pattern: str, is_regex: bool = False, engine: str = "native") -> DataFrame:
    """path, line and text of matching lines, found by a registered engine."""
    if engine not in _ENGINES:
        raise ValueError(f"unknown engine {engine!r}; known: {', '.join(sorted(_ENGINES))}")
    return _ENGINES[engine](spark, path, pattern, is_regex)


def _native(spark: SparkSession, path: str, pattern: str, is_regex: bool) -> DataFrame:
    hit = F.col("text").rlike(pattern) if is_regex else F.col("text").contains(pattern)
    return read_lines(spark, path).where(hit)


class LiteralSource(DataSource):
    """Python data source of matching lines: one partition per byte range of a file. Options: path (folder or file), pattern, regex.

    Reads every file whole, whatever its size and content, as the native engine does; ``scan_tree`` tells large and binary files.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_literal"

    def schema(self) -> str:
        return "path string, line int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _LiteralReader(self.options)


class _FilePartition(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _LiteralReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options["pattern"]
        self.is_regex = str(options.get("regex", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            paths = [self.path]
        elif os.path.isdir(self.path):
            # A checksum file that Hadoop lays beside a file is no text of anybody.
            paths = [os.path.join(d, f) for d, _, names in os.walk(self.path) for f in sorted(names) if not (f.startswith(".") and f.endswith(".crc") and f[1:-4] in names)]
        else:
            raise FileNotFoundError(self.path)
        # The last range also takes the empty line behind a closing line break.
        return [_FilePartition(p, s, s + RANGE_BYTES) for p in paths for s in range(0, os.path.getsize(p) + 1, RANGE_BYTES)]

    def read(self, partition: _FilePartition) -> Iterator[tuple]:
        """Matching lines whose first byte lies in the range. Lines before it are only counted."""
        with open(partition.path, "rb") as f:
            line, left = 1, max(0, partition.start - 1)
            while left and (chunk := f.read(min(left, 1 << 20))):
                line, left = line + chunk.count(b"\n"), left - len(chunk)
            if partition.start:
                line += f.readline().endswith(b"\n")
            while (at := f.tell()) < partition.end:
                raw = f.readline()
                if not raw and at and not self._ends_with_break(f, at):
                    return
                text = (raw[:-1].removesuffix(b"\r") if raw.endswith(b"\n") else raw).decode("utf-8", "replace")
                if re.search(self.pattern, text) if self.is_regex else self.pattern in text:
                    yield partition.path, line, text
                if not raw:
                    return
                line += 1

    @staticmethod
    def _ends_with_break(f, end: int) -> bool:
        f.seek(end - 1)
        return f.read(1) == b"\n"


def _data_source(spark: SparkSession, path: str, pattern: str, is_regex: bool) -> DataFrame:
    spark.dataSource.register(LiteralSource)
    return spark.read.format("tidemark_literal").option("path", path).option("pattern", pattern).option("regex", str(is_regex).lower()).load()


register_engine("native", _native)
register_engine("datasource", _data_source)


# ---- index records

_IMPORT = r"(?m)^\s*(?:import\s.*?from\s+['\"]([^'\"]+)['\"]|import\s+['\"]([^'\"]+)['\"]|from\s+(\S+)\s+import\b)"
_HOOK = r"\b(use[A-Z]\w*)\s*\("


def index_records(files: DataFrame) -> DataFrame:
    """One record for each file of ``files`` (path, text): path, size (bytes of UTF-8), lines (breaks), chars (code points), sha1, and the names in it by form.

    Names, each once, in order of appearance: symbols, imports (module specifiers) and hooks. A null text has no record. All of it runs in the JVM.
    """
    t = F.col("text")
    every = lambda pattern, *groups: F.array_distinct(F.filter(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(g)) for g in groups])), lambda x: x != ""))
    symbols = "(?m)" + _SYMBOL.pattern
    return files.where("text IS NOT NULL").select(
        "path", F.octet_length(t).cast("long").alias("size"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("lines"), F.length(t).cast("long").alias("chars"), F.sha1(F.encode(t, "UTF-8")).alias("sha1"),
        every(symbols, 2, 3, 5).alias("symbols"), every(_IMPORT, 1, 2, 3).alias("imports"), every(_HOOK, 1).alias("hooks"))


# ---- symbol extraction

_SYMBOL = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(function|class)\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=|(def)\s+([A-Za-z_]\w*))")


def extract_symbols(lines: DataFrame) -> DataFrame:
    """Declared names of code lines (path, line, text) by form: path, line, kind, name, is_export. JVM-side regular expressions only."""
    p = _SYMBOL.pattern
    word = lambda i: F.regexp_extract("text", p, i)
    name = F.concat(word(2), word(3), word(5))
    kind = F.when(word(1) != "", word(1)).when(word(4) != "", "function").otherwise("symbol")
    return lines.where(F.col("text").rlike(p)).select("path", "line", kind.alias("kind"), name.alias("name"), F.col("text").rlike(r"^\s*export\b").alias("is_export"))


def extract_calls(lines: DataFrame) -> DataFrame:
    """Names called on each line: path, line, callee. Keywords that look like calls are left out."""
    names = F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1))
    keywords = ["if", "for", "while", "switch", "return", "function", "catch", "def", "elif", "with"]
    return lines.select("path", "line", F.explode(F.array_distinct(F.filter(names, lambda n: ~n.isin(keywords)))).alias("callee"))
