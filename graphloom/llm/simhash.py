"""SimHash near-duplicates: vantage-point partitions of 64-bit fingerprints under Hamming distance.

Equal fingerprints collapse to one first; ``vantage`` finds the links among the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import arrow, rows, texts_of, written
from graphloom.llm.components import components
from graphloom.llm.similar import row_groups, small
from graphloom.llm.vantage import BITS, links


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased: a bit is set if set in over half the shingles' XXH64."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    stops = lengths.cumsum() + np.arange(len(parts))
    starts = (stops - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops[words - 1 :].tolist(), strict=False)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 256):  # sums of up to 255 bits fit a byte
        bits = np.unpackbits(hashes[at : at + 255 * 256].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        for block in range(0, len(bits), 255):
            counts += bits[block : block + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (fp: the 64 bits as a signed long)."""

    def run(batches):
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            fps = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield arrow({"doc_id": pa.int64(), "fp": pa.int64()}, (doc_ids, fps))

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, shard_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: documents linked at ``radius`` or fewer differing bits, directly or through others;
    component_id is the smallest doc_id of the component.

    Null and empty texts have fingerprint zero and link to each other like any others; repeated rows stay; an empty
    table gives an empty one; other columns are ignored."""
    found = written(fingerprints(docs, words, id_col, text_col))
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, radius, shard_rows))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that the join deals both sides anew and Spark can split the partition of a large component.
    least = written(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = classes.join(least, "root").select("fp", "component_id")
    return found.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all rows of a near-duplicate group but one: that with the smallest doc_id (rows without one come last), then the first
    as ``docs`` is read.

    Groups are those of rows that share ``similarity`` of their word shingles (``similar.row_groups``); fingerprints within a few bits are no
    reason to remove a text. Rows are told apart by a number that they get when they are written, not by doc_id: of several rows with one doc_id
    those with other texts stay. Null and empty texts are one group; an empty table gives an empty one; columns are as they were."""
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = row_groups(numbered.select(F.col(row).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), words, similarity)
    # A group's row is chosen among those that share their group with another, so a row that is alone is never looked at again.
    several = written(groups.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"))
    members = groups.join(small(several), "root", "left_semi")
    named = members.join(numbered.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id")), "row")
    first = written(named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")).select("m.row"))
    gone = written(members.join(small(first), "row", "left_anti").select(F.col("row").alias(row)))
    return numbered.join(small(gone), row, "left_anti").select(docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
