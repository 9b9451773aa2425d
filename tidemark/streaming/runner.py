"""Running streams to the end of what is available, with checkpoints and results in the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import ensure_checkpoint_dir


def stream_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return os.path.join(base, f"stream-{uuid.uuid4().hex}")


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table (file or folder) as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        # A file source watches folders, so a single file is picked out of its folder.
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Process everything available and return the result table.

    append writes parquet files exactly once; complete and update keep the result of the last batch that had one (complete), or all batches'
    changes with batch_id (update). Calling again with the same folder goes on from the checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or stream_folder(spark)
    out, log = f"{folder}/out", f"{folder}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.foreachBatch(lambda df, i: df.withColumn("batch_id", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    reader = spark.read.schema(stream.schema) if mode != "update" else spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())]))
    return reader.parquet(f"{out}/*" if mode == "update" else out)
