"""Session-level services: lineage cuts in the shared folder, table loading and size checks."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
# Functions of this package travel to the executors with the tasks, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules["tidemark"])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, as a lazy parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; choose a folder only on a single machine where none is set."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage; a lost executor loses nothing of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``df`` cut as by ``cut``, and its number of rows that meet ``condition``, counted in the same pass."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    done = df.observe(seen, F.count_if(condition).alias("n")).checkpoint(eager=True)
    return done, seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for work that costs far more than moving its rows.

    Large inputs come in enough splits and are left as they are; only a small input of a few files is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Fail early and by name if a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
