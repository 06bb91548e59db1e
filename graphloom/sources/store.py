"""Tables that several steps read: written once to a folder that all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a local one is set in local mode (tests); on a cluster that is an error,
    as executors would write to disks that others do not see."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_paths: list[str] = []


def marked() -> int:
    """How many tables this process has written: a place in their order, for ``clear``."""
    return len(_paths)


def clear(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Deletes the tables that this process has written to the shared folder, or those between two marks; frames that read them are of no use then."""
    n, gone = 0, _paths[first:last]
    del _paths[first:last]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Rows of an Arrow batch while a table is written, at most: texts may be long, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1024
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, readable after any executor is lost."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"graphloom-{uuid.uuid4().hex}")
    _paths.append(path)
    before = spark.conf.get(ARROW_ROWS)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    try:
        (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def released(df: DataFrame) -> DataFrame:
    """``written``, after which the shuffle files of what led to it go: Spark removes them when the driver collects its garbage, which may be long after."""
    out = written(df)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out
