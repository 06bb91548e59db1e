"""Logs and progress as streams: files that grow are read as they come, aggregates and keyed tables follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom import schemas
from graphloom.operators.cost import usage_buckets
from graphloom.operators.graph import upsert


def read(spark: SparkSession, path: str, schema: str = schemas.EXTRACTION_LOG, files_each: int = 1000) -> DataFrame:
    """Line-oriented JSON files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(path)


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens by stage and prompt, complete after every batch."""
    total = lambda f: F.sum(F.coalesce(f"usage.{f}", F.lit(0))).alias(f)
    return calls.groupBy("stage", "prompt_id").agg(F.count("*").alias("calls"), total("input_tokens"), total("output_tokens"))


def usage_by_window(calls: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and tokens by window of their timestamp; records later than the watermark are left out."""
    timed = calls.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("window"), "stage").agg(F.count("*").alias("calls"), F.sum(F.coalesce("usage.input_tokens", F.lit(0))).alias("input_tokens"))


def into_table(stream: DataFrame, path: str, keys: list[str], checkpoint: str, now: bool = True):
    """Each batch written over a keyed Parquet table, last row a key; batch ids name the versions, so a batch that runs twice writes the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), "updated_at").alias("r")).select(*keys, "r.*")
        table = latest if batch_id == 0 else upsert(spark.read.parquet(f"{path}/v{batch_id - 1}"), latest, keys)
        table.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer).start()


def first_answers(requests: DataFrame, key: str = "key", late: str = "1 hour", time: str = "at") -> DataFrame:
    """Each key once, however many callers ask, within the watermark: what goes to a paid service."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def summarise(spark: SparkSession, path: str) -> DataFrame:
    """The same totals in one batch, from the files as they are."""
    return usage_buckets(spark.read.schema(schemas.EXTRACTION_LOG).json(path))


def each(stream: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None]):
    """Runs an action on each batch of what is there, then ends."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
