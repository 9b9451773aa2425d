"""Tables on parquet: replace by key, append, latest-wins, delete, snapshots, keyed caches, browsing."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def swap(df: DataFrame, path: str) -> None:
    """Replace a table by ``df`` (which may read it): write beside it, then rename, so a failed write leaves the old rows."""
    spark = df.sparkSession
    fresh = f"{path}.next-{uuid.uuid4().hex[:8]}"
    df.write.parquet(fresh)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, source, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, f"{path}.old-{uuid.uuid4().hex[:8]}"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(source, target)
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def replace_keys(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Replace all stored rows of the keys that ``rows`` has (delete and insert of whole files' rows)."""
    if not _exists(spark, path):
        rows.write.parquet(path)
        return
    kept = spark.read.parquet(path).join(rows.select(*keys).distinct(), keys, "left_anti")
    swap(kept.unionByName(rows, allowMissingColumns=True), path)


def delete_keys(spark: SparkSession, path: str, gone: DataFrame, keys: list[str]) -> None:
    """Delete the rows of the given keys."""
    swap(spark.read.parquet(path).join(gone.select(*keys).distinct(), keys, "left_anti"), path)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Idempotent import: the partitions that ``rows`` touches are overwritten, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Latest-wins view of an append-only table."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def seed_from(parent: DataFrame, stamps: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a parent table whose keys (path and content hash) a new checkout has as well."""
    return parent.join(stamps.select(*keys).distinct(), keys, "left_semi")


def sync_plan(stored: DataFrame, listed: DataFrame, slack_ms: int = 2000) -> DataFrame:
    """Change list of an incremental sync: path and action (add, remove, changed, check, same).

    ``stored``: path, mtime, size, synced_at; ``listed``: path, mtime, size (both instants in ms). A row of equal stamp whose mtime lies within
    ``slack_ms`` of the sync is ambiguous and has to be checked by content.
    """
    s = stored.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), "synced_at", F.lit(True).alias("old"))
    n = listed.select("path", F.col("mtime").alias("m2"), F.col("size").alias("s2"), F.lit(True).alias("new"))
    action = (
        F.when(F.col("new").isNull(), "remove").when(F.col("old").isNull(), "add").when((F.col("m1") != F.col("m2")) | (F.col("s1") != F.col("s2")), "changed")
        .when(F.col("m2") + slack_ms >= F.col("synced_at"), "check").otherwise("same")
    )
    return s.join(n, "path", "full_outer").select("path", action.alias("action"))


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """Result stored under a key: built and written once, read afterwards. The key must name inputs, code and options."""
    path = os.path.join(folder, hashlib.sha256(key.encode()).hexdigest()[:32])
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tables(spark: SparkSession) -> DataFrame:
    """Registered views and tables with their row counts."""
    rows = [(t.name, t.tableType, spark.table(t.name).count()) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, n_rows long")


def structure(df: DataFrame) -> DataFrame:
    """Columns of a table: position, name, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def browse(df: DataFrame, key: str, page: int = 1, limit: int = 50) -> DataFrame:
    """A page of a table, ordered by its key; limits are kept within 1 and 200."""
    size = max(1, min(200, limit))
    return df.orderBy(key).offset((max(1, page) - 1) * size).limit(size)


def page_envelope(total: int, limit: int, offset: int, count: int) -> dict:
    """Where a page stands in the whole result."""
    more = offset + count < total
    return {"total": total, "page": offset // limit + 1, "hasMore": more, "nextOffset": offset + count if more else None}
