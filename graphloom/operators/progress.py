"""Progress of long runs as keyed tables: what is done, what is due, and results stored on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.graph import last_writer, upsert

KEY = ["project_id", "file_path"]


def register(progress: DataFrame, files: DataFrame) -> DataFrame:
    """``progress`` with a pending row for each file it lacks."""
    new = files.select(*KEY).distinct().join(progress.select(*KEY), KEY, "left_anti").withColumn("stage", F.lit("pending"))
    return progress.unionByName(new, allowMissingColumns=True)


def mark(progress: DataFrame, changes: DataFrame) -> DataFrame:
    """``progress`` with the stages and results in ``changes``; only files that are registered change."""
    known = changes.join(progress.select(*KEY), KEY, "left_semi")
    return upsert(progress, known, KEY)


def pending(progress: DataFrame, project_id: str | None = None) -> DataFrame:
    due = progress.where("stage != 'completed'")
    return (due if project_id is None else due.where(F.col("project_id") == project_id)).select(*KEY).orderBy(*KEY)


def completed(progress: DataFrame, project_id: str | None = None) -> DataFrame:
    done = progress.where("stage = 'completed'")
    return (done if project_id is None else done.where(F.col("project_id") == project_id)).select(*KEY, "llm_results").orderBy(*KEY)


def summary(progress: DataFrame) -> DataFrame:
    return progress.groupBy("project_id", "stage").agg(F.count("*").alias("n"))


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests that must be answered anew, each key once."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def answered(requests: DataFrame, cache: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Every request with its answer, the cached one first."""
    both = cache.withColumn("_rank", F.lit(1)).unionByName(new.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    return requests.join(last_writer(both, [key], ["_rank"]).drop("_rank"), key, "left")


def state(table: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """A key-value table with one value written."""
    spark = table.sparkSession
    one = spark.range(1).select((F.lit(key) if isinstance(key, str) else key).alias("key"), (F.lit(value) if isinstance(value, str) else value).alias("value"))
    return upsert(table, one, ["key"])


def has_current_key(columns: list[str]) -> bool:
    """Whether a stored progress table is keyed by project and file; an older one starts anew."""
    return set(KEY) <= set(columns)
