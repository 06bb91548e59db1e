"""Ranking texts for a query: BM25, cosine, and filling a budget in rank order."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from graphloom.functions.text import token_estimate, tokens
from graphloom.functions.udf import arrow_udf
from graphloom.operators import lexical
from graphloom.sources.store import clear, marked, written

K1, B = 1.5, 0.75
#: Terms of a block of queries that is lent to the tasks.
QUERY_TERMS = 200_000
BUDGET = 7000


def term_index(docs: DataFrame, doc_id: str, text: Column, terms=tokens) -> tuple[DataFrame, DataFrame]:
    """``doc_id, term, tf`` and ``doc_id, dl``: the inverted index and the lengths of all documents, empty ones too."""
    split = docs.select(F.col(doc_id).alias("doc_id"), terms(text).alias("terms"))
    postings = split.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return postings, split.select("doc_id", F.size("terms").alias("dl"))


def bm25(
    docs: DataFrame, queries: DataFrame, doc_id: str, text: Column, query_id: str, query: Column, terms: lexical.Terms = lexical.CODE_TERMS, k1: float = K1, b: float = B,
    k: int | None = None, digits: int | None = None, block: int = QUERY_TERMS,
) -> DataFrame:
    """``query_id, doc_id, score`` of every document that shares a term with the query; all others score 0 and have no row. With ``k``, the ``k`` best of each
    query and their ``rank``, ties by ``doc_id``; scores are rounded to ``digits`` beforehand.

    The inverse document frequency is ln(1 + (N - n + 0.5) / (n + 0.5)); a term counts as often as the query has it. Texts are split once a block of queries, into a
    written table with a row a document: its length and its numbers of query terms. A task scores whole documents of it, so no pair of a document and a query
    is shuffled, and with ``k`` leaves its own best only. Queries are a stated set, lent to the tasks in as many blocks of about ``block`` terms as they need. Rows with one
    id are one document, those of one length with all their terms, as in the SQL that groups by both."""
    asked = queries.select(F.col(query_id).alias("query_id"), query.cast("binary").alias("text"))
    schema = StructType([asked.schema["query_id"], StructField("term", StringType()), StructField("qtf", LongType())])
    asked = written(asked.mapInArrow(lexical.query_terms(terms), schema).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")))
    blocks = max(1, -(-asked.count() // block))
    found = []
    for i in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        before = marked()
        scored = _block(docs.select(F.col(doc_id).alias("doc_id"), text.cast("binary").alias("text")), own, terms, k1, b, k, digits)
        if k:
            scored = top_k(scored, k, order=[F.desc("score"), F.asc_nulls_last("doc_id")])
        if blocks > 1:
            after = marked()
            scored = written(scored)
            clear(docs.sparkSession, before, after)
        found.append(scored)
    return reduce(DataFrame.unionByName, found)


def _block(docs: DataFrame, asked: DataFrame, terms: lexical.Terms, k1: float, b: float, k: int | None, digits: int | None) -> DataFrame:
    """``query_id, doc_id, score`` for ``doc_id, text`` and one block of ``query_id, term, qtf``."""
    context, id_of = docs.sparkSession.sparkContext, docs.schema["doc_id"]
    got = asked.orderBy("query_id", "term").toArrow().combine_chunks()
    query = got.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    term = got.column("term").combine_chunks().dictionary_encode()
    places = context.broadcast({t.encode(): i for i, t in enumerate(term.dictionary.to_pylist())})
    schema = StructType([id_of, StructField("dl", LongType()), *(StructField(c, ArrayType(IntegerType())) for c in ("terms", "tfs"))])
    rows = written(docs.mapInArrow(lexical.document_terms(terms, places), schema))
    n_docs, avgdl = rows.agg(F.count("*"), F.avg("dl")).first()
    entries = rows.where(F.size("terms") > 0).select("doc_id", "terms", "tfs", F.array_repeat("dl", F.size("terms")).alias("dls"))
    again = written(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    if again.take(1):
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        each = rows.join(again, same, "left_semi").select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).groupBy("doc_id", "dl", "e.terms").agg(F.sum("e.tfs").alias("tf"))
        lists = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("terms", "dl", F.col("tf").cast("int").alias("tf")))).alias("l"))
        entries = written(entries.join(again, same, "left_anti").unionByName(lists.select("doc_id", F.col("l.terms").alias("terms"), F.col("l.tf").alias("tfs"), F.col("l.dl").alias("dls"))))
    counted = entries.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(term.dictionary))
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weights = lexical.Weights.of(query.dictionary, term.indices.to_numpy(), query.indices.to_numpy(), got.column("qtf").to_numpy(), df, n_docs, avgdl or 1.0, k1, b)
    schema = StructType([asked.schema["query_id"], id_of, StructField("score", DoubleType())])
    return entries.mapInArrow(lexical.scored(context.broadcast(weights), k, digits), schema)


def top_k(scored: DataFrame, k: int, group: str = "query_id", order=None) -> DataFrame:
    """The ``k`` best rows of each group with their ``rank``."""
    order = order or [F.desc("score"), F.asc("doc_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; where a norm is 0, the divisor is 1."""
    size = norm(a) * norm(b)
    return dot(a, b) / F.when(size == 0, 1.0).otherwise(size)


def dense_rank(docs: DataFrame, queries: DataFrame, doc_id: str, vector: str, query_id: str, query_vector: str) -> DataFrame:
    """``query_id, doc_id, score``. Every query is held against every vector: the query side must be a small, stated set."""
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(vector).cast("array<double>").alias("_v"))
    right = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("_q"))
    return left.crossJoin(right).select("query_id", "doc_id", cosine(F.col("_v"), F.col("_q")).alias("score"))


def _fits(costs: list[int], start: int, room: int) -> list[bool]:
    """Which of the costs are taken, each if it still fits."""
    used, out = start, []
    for cost in costs:
        out.append(used + cost <= room)
        used += cost if out[-1] else 0
    return out


_fits_udf = arrow_udf(_fits, "array<boolean>")


def first_fit(ranked: DataFrame, group: str, order: list, item: str, cost: str, budget: int | str = BUDGET, start: str | None = None) -> DataFrame:
    """``group, included, skipped, used``: items in order, each taken if it still fits; one that does not fit is passed over and takes nothing.

    ``budget`` may be a column. A group is a ranked list for one query; callers cut zero scores off first. One pass over a list's costs
    decides, so its work is linear."""
    room = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    entry = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(item).alias("item"), F.col(cost).cast("bigint").alias("cost"))
    first = F.coalesce(F.first(F.col(start)), F.lit(0)) if start else F.lit(0)
    lists = ranked.groupBy(group).agg(F.sort_array(F.collect_list(entry)).alias("entries"), first.cast("bigint").alias("start"), F.first(room).cast("bigint").alias("room"))
    taken = lists.withColumn("taken", _fits_udf(F.transform("entries", lambda e: e["cost"]), "start", "room"))
    marked = taken.select(group, "start", F.zip_with("entries", "taken", lambda e, t: F.struct(e["item"].alias("item"), e["cost"].alias("cost"), t.alias("taken"))).alias("m"))
    kept, passed = F.filter("m", lambda x: x["taken"]), F.filter("m", lambda x: ~x["taken"])
    used = F.aggregate(kept, F.col("start"), lambda s, x: s + x["cost"])
    return marked.select(group, F.transform(kept, lambda x: x["item"]).alias("included"), F.transform(passed, lambda x: x["item"]).alias("skipped"), used.alias("used"))


def prefix_within(df: DataFrame, group: str, order: list, cost: str, budget: int) -> DataFrame:
    """The longest head of each ordered group whose costs add up to the budget at most: what popping from the tail leaves."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_total", F.sum(cost).over(w)).where(F.col("_total") <= budget).drop("_total")


def rank_position(df: DataFrame, group: str, order: list, cap: int = 20) -> DataFrame:
    """``position`` as text: the rank, or ``>cap``."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_n", n).withColumn("position", F.when(F.col("_n") <= cap, F.col("_n").cast("string")).otherwise(F.lit(f">{cap}"))).drop("_n")


def bm25_context(docs: DataFrame, queries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``query_id, included, skipped, used`` for files (``path, source``) and specs (``query_id, spec``): ranked with the path as text, filled
    in rank order."""
    scored = bm25(docs, queries, "path", F.concat_ws(" ", "path", "source"), "query_id", F.col("spec")).where("score > 0")
    priced = scored.join(docs.select(F.col("path").alias("doc_id"), token_estimate(F.col("source")).alias("cost")), "doc_id")
    priced = priced.join(queries.select("query_id", token_estimate(F.col("spec")).alias("start")), "query_id")
    return first_fit(priced.withColumn("_neg", -F.col("score")), "query_id", ["_neg", "doc_id"], "doc_id", "cost", budget, "start")
