"""Logs, results, caches and settings."""

from __future__ import annotations

import tomllib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom import schemas
from graphloom.functions.udf import series_udf
from graphloom.operators.graph import first_writer


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of line-oriented JSON with the file they are in; blank lines don't count, a missing path has none."""
    try:
        return spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, file string")


def calls(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.CALL_LOG)


def extraction_calls(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.EXTRACTION_LOG)


def harness_results(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a candidate; the run is the folder it lies in. Duplicates stay, for the gate that looks for them."""
    found = spark.read.schema(schemas.HARNESS_RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return found.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a heading."""
    return spark.read.option("header", True).schema(schema).csv(path)


def toml(path: str) -> dict:
    return tomllib.loads(Path(path).read_text())


def settings(path: str) -> dict:
    """Aliases, base URL and excluded paths by project from a settings file; what is not there is empty."""
    found = toml(path)
    return {name: {"aliases": p.get("aliases", {}), "base_url": p.get("base_url", ""), "exclude_paths": p.get("exclude_paths", [])} for name, p in found.get("projects", {}).items()}


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task descriptions, JSON or (where a reader is installed) YAML, one file each: a handful of files, read by the driver."""
    rows = []
    for file in sorted(Path(path).glob("*")):
        if file.suffix in (".yaml", ".yml"):
            import yaml  # optional

            rows.append(yaml.safe_load(file.read_text()))
        elif file.suffix == ".json":
            import json

            rows.append(json.loads(file.read_text()))
    names = [x.split()[0] for x in schemas.TASK.replace("struct<anchor_names:array<string>,anchor_routes:array<string>>", "struct").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.TASK)


def table_after(text: Column, anchor: str) -> Column:
    """The rows of the first Markdown table behind an anchor, as arrays of cells; heading and rule lines are not among them."""
    lines = F.split(F.substring_index(text, anchor, -1), "\n")
    marked = F.transform(lines, lambda x: F.trim(x).startswith("|"))
    start = F.array_position(marked, F.lit(True)).cast("int")
    rest = F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: F.trim(x).startswith("|")), F.lit(False)).cast("int")
    rows = F.slice(rest, 1, F.when(end > 0, end - 1).otherwise(F.size(rest)))
    cells = lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.when((start > 0) & F.contains(text, F.lit(anchor)), F.transform(F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0))), cells))


@series_udf("array<float>")
def decode_vector(encoded: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats from bytes."""
    return encoded.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@series_udf("binary")
def encode_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Cached embeddings with their ``embedding``; of several lines with one key the first counts."""
    found = jsonl(spark, path, schemas.EMBEDDING_CACHE).withColumn("_at", F.struct("file", F.monotonically_increasing_id()))
    first = first_writer(found, ["key"], ["_at"]).drop("_at")
    return first.withColumn("embedding", decode_vector(F.unbase64("embedding_b64")))


def headers(raw: Column) -> Column:
    """Header names in lower case without the gateway's prefix; a plain name wins over a prefixed one, empty values go."""
    entries = F.filter(F.map_entries(raw), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    plain = F.filter(lowered, lambda e: ~e["key"].startswith("llm_provider-"))
    bare = F.transform(F.filter(lowered, lambda e: e["key"].startswith("llm_provider-")), lambda e: F.struct(F.regexp_replace(e["key"], "^llm_provider-", "").alias("key"), e["value"].alias("value")))
    names = F.transform(plain, lambda e: e["key"])
    return F.map_from_entries(F.concat(plain, F.filter(bare, lambda e: ~F.array_contains(names, e["key"]))))


def provider(body: Column, raw: Column) -> Column:
    """Who served a call: the body says, else the headers."""
    h = headers(raw)
    return F.coalesce(F.nullif(body, F.lit("")), *[F.try_element_at(h, F.lit(k)) for k in ("x-openrouter-provider", "x-provider-name")])


def prompt_text(prompt: Column) -> Column:
    """The contents of a prompt's messages, one below the other."""
    return F.array_join(F.transform(F.coalesce(prompt, F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


ANSWER = "task_type string, anchor_names array<string>, anchor_routes array<string>"


def classifier_answer(text: Column) -> Column:
    """``task_type, anchor_names, anchor_routes`` of an answer: fences off, else the outermost braces; what cannot be read is a bug fix without anchors."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", ""))
    parsed = F.coalesce(F.when(F.get_json_object(bare, "$").isNotNull(), F.from_json(bare, ANSWER)), F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), ANSWER))
    none = F.array().cast("array<string>")
    kind = F.when(parsed["task_type"].isin("bug_fix", "feature_addition", "refactoring"), parsed["task_type"]).otherwise("bug_fix")
    return F.struct(kind.alias("task_type"), F.array_compact(F.coalesce(parsed["anchor_names"], none)).alias("anchor_names"), F.array_compact(F.coalesce(parsed["anchor_routes"], none)).alias("anchor_routes"))
