"""JSON-lines sources and sinks, run folders, federated reads and the columnar wire form."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Records of JSON lines; blank and torn lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_counted(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, one row with n_records and n_malformed) of JSON lines. Lines are parsed once as text, so both stay lazy."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    counts = parsed.agg(F.count_if("ok").alias("n_records"), F.count_if(~F.col("ok")).alias("n_malformed"))
    return parsed.where("ok").select("r.*"), counts


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a Hadoop glob, sorted."""
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def read_run(spark: SparkSession, folder: str, entry_schema: T.StructType, meta_schema: T.StructType) -> DataFrame:
    """Entries of a run folder (files agent-<id>.jsonl, or folders agent=<id> as written by agent) with agent from the name and the label of
    agent-<id>.meta.json or meta/agent=<id>; a missing label is null. Any file system of the session will do."""
    name = F.regexp_extract(F.input_file_name(), r"agent[-=]([^/]+?)(?:\.jsonl|\.meta\.json)?(?:/[^/]*)?$", 1)

    def rows(schema: T.StructType, patterns: list[str], **options) -> DataFrame:
        found = [p for g in patterns for p in _matches(spark, f"{folder}/{g}")]
        if not found:
            return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("agent", T.StringType())]))
        # Paths given one by one keep their folders' names out of the schema.
        return spark.read.schema(schema).options(**options).option("basePath", folder).json(found).withColumn("agent", name)

    entries = rows(entry_schema, ["agent-*.jsonl", "agent=*"], mode="DROPMALFORMED")
    labels = rows(meta_schema, ["agent-*.meta.json", "meta/agent=*"], multiLine=True)
    return entries.join(labels.groupBy("agent").agg(*[F.min(f.name).alias(f.name) for f in meta_schema.fields]), "agent", "left")


def discover(root: str, name: str, max_depth: int = 4) -> list[str]:
    """Paths called ``name`` at most ``max_depth`` folders below a root of any file system of the session, sorted."""
    spark = SparkSession.active()
    found = {p for k in range(max_depth + 1) for p in _matches(spark, "/".join([root.rstrip("/"), *["*"] * k, name]))}
    return sorted(p if ":" in root else p.removeprefix("file:") for p in found)


def federated(spark: SparkSession, sources: dict[str, str], schema: T.StructType) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(rows with source, errors) of several parquet ledgers: one that cannot be read is reported beside the others' rows."""
    frames, errors = [], []
    for label, path in sorted(sources.items()):
        try:
            frame = spark.read.parquet(path)
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            frames.append(frame.select(F.lit(label).alias("source"), *columns))
        except AnalysisException as e:
            errors.append((label, str(e).splitlines()[0]))
    empty = spark.createDataFrame([], T.StructType([T.StructField("source", T.StringType()), *schema.fields]))
    return reduce(DataFrame.unionByName, frames, empty), errors


def to_columnar(df: DataFrame, limit: int, accessors: dict | None = None) -> dict:
    """{cols, rows} of at most ``limit`` rows: the wire form of a page. ``accessors`` maps a name to a column expression."""
    chosen = df.select(*[(accessors or {}).get(c, F.col(c)).alias(c) for c in df.columns]).limit(limit)
    return {"cols": chosen.columns, "rows": [list(r) for r in chosen.collect()]}


def from_columnar(spark: SparkSession, columnar: dict, schema: T.StructType | None = None) -> DataFrame:
    """Frame of a {cols, rows} page; missing trailing cells are null."""
    width = len(columnar["cols"])
    rows = [tuple(r) + (None,) * (width - len(r)) for r in columnar["rows"]]
    return spark.createDataFrame(rows, schema or columnar["cols"]) if rows or schema else spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columnar["cols"]]))


def export_since(df: DataFrame, at: str, cursor: str, target: str) -> int:
    """Append rows newer than the stored cursor as markdown list lines and move the cursor; returns the number of rows.

    ``df`` needs kind and note; ``at`` is LONG. ``cursor`` is a small JSON file on any file system of the session, written only after the lines were.
    """
    spark = df.sparkSession
    fs, p = _fs(spark, cursor)
    seen = spark.read.schema("cursor long").json(cursor).first()["cursor"] if fs.exists(p) else -1
    fresh = df.where(F.col(at) > seen)
    stats = fresh.agg(F.count("*").alias("n"), F.max(at).alias("last")).first()
    if stats["n"]:
        # Only what this call counted, should rows arrive meanwhile.
        line = F.concat(F.lit("- "), F.col("kind"), F.lit(": "), F.regexp_replace(F.coalesce("note", F.lit("")), r"[\r\n]+", " "))
        fresh.where(F.col(at) <= stats["last"]).sort(at).select(line.alias("value")).write.mode("append").text(target)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"cursor": stats["last"]}).encode()))
        out.close()
    return stats["n"]
