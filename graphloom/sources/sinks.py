"""Where results go."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.paths import flattened
from graphloom.operators.graph import Graph, edge_type_counts, first_writer, label_counts


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def artifacts(df: DataFrame, path: str) -> None:
    """Rows as JSON below run and candidate, instead of a file a row."""
    df.write.mode("append").partitionBy("run_id", "candidate_id").json(path)


def report_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report table with a fixed column order; reports are small and go to one file."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small report table as Markdown; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "–" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]
    return "\n".join(lines) + "\n"


def manifest(graph: Graph, path: str) -> dict:
    """Counts by label and relationship as a JSON file."""
    found = {"nodes": {r.label: r.n for r in label_counts(graph.nodes).collect()}, "edges": {r.rel: r.n for r in edge_type_counts(graph.edges).collect()}}
    found |= {"node_count": sum(found["nodes"].values()), "edge_count": sum(found["edges"].values())}
    Path(path).write_text(json.dumps(found, indent=2, sort_keys=True))
    return found


def merge_toml(path: str, new: dict[str, int]) -> dict:
    """Numbers under their names; a name that the file has keeps its number unless ``new`` has it."""
    import tomllib

    file = Path(path)
    merged = (tomllib.loads(file.read_text()) if file.exists() else {}) | new
    file.write_text("".join(f"{k} = {v}\n" for k, v in sorted(merged.items())))
    return merged


def append_cache(cache: DataFrame | None, new: DataFrame, path: str, key: str = "key") -> None:
    """New entries whose key the cache lacks; of several with one key the first."""
    order = [c for c in new.columns if c != key][:1]
    fresh = first_writer(new, [key], order)
    (fresh if cache is None else fresh.join(cache.select(key), key, "left_anti")).write.mode("append").parquet(path)


def raw_extractions(df: DataFrame, path: str) -> None:
    """Extraction records under the flattened name of their file."""
    df.withColumn("name", F.concat(flattened(F.col("file_path")), F.lit(".json"))).write.mode("overwrite").partitionBy("project_id").json(path)


def file_manifest(files: DataFrame) -> DataFrame:
    """``project_id, file_count, files`` as one record a project."""
    return files.groupBy("project_id").agg(F.count("*").alias("file_count"), F.sort_array(F.collect_list("file_path")).alias("files"))


def provenance(path: str, record: dict, prompts: dict[str, bytes]) -> dict:
    """A run's record with the hash of its prompts, names and bytes in order."""
    import hashlib

    h = hashlib.sha256()
    for name in sorted(prompts):
        h.update(name.encode() + b"\0" + prompts[name] + b"\0")
    out = record | {"prompt_set": h.hexdigest()}
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True))
    return out


def read_provenance(path: str) -> dict | None:
    file = Path(path)
    return json.loads(file.read_text()) if file.exists() else None
