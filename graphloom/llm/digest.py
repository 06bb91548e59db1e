"""Canonical exact digests: Unicode normalisation, case and white-space folding, then a 128-bit xxhash.

Documents with one digest form a bucket; inside a bucket canonical texts are compared byte by byte, so a collision
of digests never joins different texts.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import arrow, rows, texts_of, written

#: Bytes of doc_ids of copied documents up to which they are broadcast; beyond, the semi-join shuffles both sides.
BROADCAST_BYTES = 16 << 20


def canonical(text: str) -> bytes:
    """NFKC, full case folding, NFKC again (folding can undo it), white-space runs as one space, none at the ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.lower().split()).encode() if text.isascii() else " ".join(text.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: tuple[str, bytes], b: tuple[str, bytes]) -> float:
    """1 for equal canonical texts and 0 for others, given (digest, bytes): bytes are compared inside equal digests."""
    return float(a[0] == b[0] and a[1] == b[1])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest) -> DataFrame:
    """``doc_id, fingerprint``: 32 hex digits. Null texts count as empty; other columns are ignored."""

    def run(batches):
        for ids, texts in rows(batches, "doc_id", "text"):
            yield arrow({"doc_id": pa.int64(), "fingerprint": pa.string()}, (ids, [digest(canonical(t)) for t in texts]))

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def group_ids(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, digest=digest) -> DataFrame:
    """``found`` (with ``doc_id`` and ``fingerprint``, stored) and ``group_id``, the smallest doc_id with the same canonical bytes.

    Only documents whose digest occurs twice are read again and send bytes; equal ones merge before the shuffle. Null and empty
    texts are one group, repeated rows stay, an empty table gives an empty one."""
    # Written, so that the joins below deal both sides anew and Spark can split the partition of a very common digest.
    copied = written(found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    ids = found.join(copied, "fingerprint").select("doc_id")
    if 8 * ids.count() <= broadcast_bytes:
        ids = F.broadcast(ids)

    def run(batches):
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            forms = [canonical(t) for t in texts]
            yield arrow({"doc_id": pa.int64(), "fingerprint": pa.string(), "form": pa.binary()}, (doc_ids, [digest(x) for x in forms], forms))

    members = texts_of(docs, id_col, text_col).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, fingerprint string, form binary")
    groups = members.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"))
    # The bytes stay behind: a bucket with one form is known by its digest; of one with several, members are held against each.
    buckets = written(groups.groupBy("fingerprint").agg(F.count("*").alias("forms"), F.min("group_id").alias("group_id")))
    alike = found.join(buckets.where("forms = 1").select("fingerprint", "group_id"), "fingerprint", "left")
    if not buckets.where("forms > 1").head(1):
        return alike.withColumn("group_id", F.coalesce("group_id", "doc_id"))
    split = buckets.where("forms > 1").select("fingerprint")
    own = members.join(split, "fingerprint", "left_semi").join(groups, ["fingerprint", "form"]).select("doc_id", F.col("group_id").alias("_own")).distinct()
    return alike.join(own, "doc_id", "left").withColumn("group_id", F.coalesce("_own", "group_id", "doc_id")).drop("_own")


NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge string, text string"
NEXT_FIELDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "part": pa.int32(), "edge": pa.string(), "text": pa.string()}


def against_next(doc_id, text: str, following: str) -> tuple:
    """A document's digest row, beside the one of its text with the second half replaced by the next document's beginning."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    own, new, other = ((digest(form), form) for form in map(canonical, (text, edited, following)))
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[0], new[0], likeness(own, new), likeness(own, other))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, where next is the
    document with the next smaller doc_id and the largest one follows the smallest.

    Texts are dealt once, by ranges of doc_id, and streamed in order; a range's first and last text are kept aside and the last
    is held against the first of the next range that has rows. Null texts count as empty, rows with one doc_id follow each
    other by hash, a single document follows itself, an empty table gives an empty one; other columns are ignored."""

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            out = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                if first:
                    out.append((doc_id, *[None] * 6, part, "first", text))
                    first = False
                else:
                    out.append((*against_next(*held, text), part, None, None))
                held = (doc_id, text)
            yield arrow(NEXT_FIELDS, zip(*out, strict=True))
        if held:
            yield arrow(NEXT_FIELDS, zip((held[0], *[None] * 6, part, "last", held[1])))

    ordered = texts_of(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.desc("doc_id"), "_tie").sortWithinPartitions(F.desc("doc_id"), "_tie").drop("_tie")
    dealt = written(ordered.mapInArrow(run, NEXT))
    names = ["doc_id", *list(NEXT_FIELDS)[1:7]]
    # One row a range: which range follows. Their number is that of the partitions, not of the documents.
    parts = dealt.where("edge = 'first'").select("part")
    turn = Window.orderBy("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(turn), F.first("part").over(turn)).alias("next"))
    heads = dealt.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = dealt.where("edge = 'last'").select("doc_id", "text", "part").join(follows, "part").join(heads, "next").select("doc_id", "text", "following")

    def close(batches):
        for doc_ids, texts, following in rows(batches, "doc_id", "text", "following"):
            yield arrow({n: NEXT_FIELDS[n] for n in names}, zip(*map(against_next, doc_ids, texts, following), strict=True))

    kinds = NEXT.split(", part")[0]
    return dealt.where("edge is null").select(*names).unionByName(ends.mapInArrow(close, kinds))


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_ids(docs, written(compare_with_next(docs)))
