"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as prompt, the
rest of each as a completion whose mask covers what the assistant wrote. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What opens a turn (its role goes between the two), and what closes it.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``pair_id, turns``: each conversation's turns as an array of ``(turn, role, text)`` in order.

    Null roles and texts count as empty; turns with one number follow each other by role, then text; repeated rows stay;
    a turn without an id belongs to no other one's conversation and is one by itself, however many there are; other columns are ignored."""
    turn = F.struct(turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"))
    alone = F.when(turns[id_col].isNull(), F.monotonically_increasing_id())
    return turns.select(turns[id_col].alias("pair_id"), alone.alias("_alone"), turn.alias("t")).groupBy("pair_id", "_alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("_alone")


def _header(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Runs of code points as ``length:0`` (not trained on) and ``length:1`` (trained on), joined by commas."""
    whole = lambda t: F.length(_header(t)) + F.length(t["text"]) + len(CLOSE)
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.when(t["role"] == TRAINED, F.concat(F.length(_header(t)).cast("string"), F.lit(":0,"), (F.length(t["text"]) + len(CLOSE)).cast("string"), F.lit(":1"))).otherwise(
                F.concat(whole(t).cast("string"), F.lit(":0"))
            ),
        ),
        ",",
    )


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pair_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask`` for rows with two arrays of turns.

    Turns are common while role and text are equal. A null array counts as an empty conversation; equal conversations are all
    prompt, with empty completions; an empty table gives an empty one."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    slim = pairs.select("pair_id", F.coalesce(pairs[chosen], none).alias("a"), F.coalesce(pairs[rejected], none).alias("b"))
    both = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, both), F.slice("b", 1, both), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, F.lit(False))
    cut = slim.withColumn("n_shared", F.when(first == 0, both.cast("long")).otherwise(first - 1))
    tail = lambda c: F.slice(c, (F.col("n_shared") + 1).cast("int"), F.greatest(F.size(c) - F.col("n_shared"), F.lit(0)).cast("int"))
    return cut.select(
        "pair_id", "n_shared", _rendered(F.slice("a", 1, F.col("n_shared").cast("int"))).alias("prompt"),
        _rendered(tail("a")).alias("chosen"), _rendered(tail("b")).alias("rejected"), _mask(tail("a")).alias("chosen_mask"), _mask(tail("b")).alias("rejected_mask"),
    )


def cut_short(turns: Column) -> Column:
    """The turns with the assistant's last answer broken off at half its length: a worse conversation to set against the whole one."""
    answers = F.transform(turns, lambda t: t["role"] == TRAINED)
    at = F.size(turns) - F.array_position(F.reverse(answers), F.lit(True))  # the size itself where there is no answer
    return F.transform(
        turns, lambda t, i: F.when(i == at, F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int")).alias("text"))).otherwise(t)
    )


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the last answer broken off."""
    whole = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    pairs = whole.select("pair_id", F.col("turns").alias("chosen"), cut_short(F.col("turns")).alias("rejected"))
    return format_pairs(pairs).withColumnRenamed("pair_id", "conv_id")


OP8_SQL = """
WITH t AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations), c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS a
  FROM t GROUP BY conv_id, alone
), k AS (
  SELECT conv_id, a, len(a) AS n, coalesce(list_max([i FOR i IN range(1, len(a) + 1) IF a[i].role = 'assistant']), 0) AS last FROM c
), p AS (
  SELECT conv_id, a, n,
    [CASE WHEN i = last THEN {'role': a[i].role, 'text': left(a[i].text, length(a[i].text) // 2)} ELSE {'role': a[i].role, 'text': a[i].text} END FOR i IN range(1, n + 1)] AS b
  FROM k
), s AS (
  SELECT conv_id, a, b, n, coalesce(list_min([i FOR i IN range(1, n + 1) IF a[i].text <> b[i].text]), n + 1) - 1 AS n_shared FROM p
)
SELECT conv_id, n_shared::BIGINT AS n_shared,
  coalesce(array_to_string(['<|' || a[i].role || '|>' || chr(10) || a[i].text || '<|end|>' || chr(10) FOR i IN range(1, n_shared + 1)], ''), '') AS prompt,
  coalesce(array_to_string(['<|' || a[i].role || '|>' || chr(10) || a[i].text || '<|end|>' || chr(10) FOR i IN range(n_shared + 1, n + 1)], ''), '') AS chosen,
  coalesce(array_to_string(['<|' || b[i].role || '|>' || chr(10) || b[i].text || '<|end|>' || chr(10) FOR i IN range(n_shared + 1, n + 1)], ''), '') AS rejected,
  coalesce(array_to_string([CASE WHEN a[i].role = 'assistant' THEN (length(a[i].role) + 5) || ':0,' || (length(a[i].text) + 8) || ':1'
    ELSE (length(a[i].role) + length(a[i].text) + 13) || ':0' END FOR i IN range(n_shared + 1, n + 1)], ','), '') AS chosen_mask,
  coalesce(array_to_string([CASE WHEN b[i].role = 'assistant' THEN (length(b[i].role) + 5) || ':0,' || (length(b[i].text) + 8) || ':1'
    ELSE (length(b[i].role) + length(b[i].text) + 13) || ':0' END FOR i IN range(n_shared + 1, n + 1)], ','), '') AS rejected_mask
FROM s
"""
