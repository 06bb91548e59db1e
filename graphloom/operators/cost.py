"""Token and money accounting of logged calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# USD for a million input and output tokens by model and provider.
PRICES = (
    ("anthropic/claude-sonnet-4-6", None, 3.00, 15.00),
    ("openrouter/qwen/qwen3-coder", "Google", 0.22, 1.80),
    ("openrouter/qwen/qwen3-coder", "DeepInfra", 0.30, 1.00),
    ("openrouter/qwen/qwen3-coder", "Venice", 0.35, 1.50),
    ("openrouter/qwen/qwen3-coder", "Novita", 0.38, 1.55),
    ("openrouter/qwen/qwen3-coder", "Alibaba", 0.975, 4.875),
    ("text-embedding-3-large", None, 0.13, 0.0),
)


def price_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    return spark.createDataFrame(list(prices), "model_id string, provider string, usd_in double, usd_out double")


def tokens(calls: DataFrame) -> DataFrame:
    """``calls`` with ``input_tokens`` and ``output_tokens``, null counts as 0."""
    return calls.withColumn("input_tokens", F.coalesce("usage.input_tokens", F.lit(0))).withColumn("output_tokens", F.coalesce("usage.output_tokens", F.lit(0)))


def priced(calls: DataFrame, prices: DataFrame, provider: str = "openrouter_provider", strict: bool = True) -> DataFrame:
    """``calls`` with ``usd``; calls without tokens cost nothing. A call whose model and provider have no price fails the query, or, if not
    ``strict``, has a null ``usd``. The provider is compared null-safe."""
    p = F.broadcast(prices.select(F.col("model_id").alias("_m"), F.col("provider").alias("_p"), "usd_in", "usd_out"))  # a literal table of a few rows
    on = calls["model_id"].eqNullSafe(p["_m"]) & calls[provider].eqNullSafe(p["_p"])
    free = (F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)
    usd = F.col("input_tokens") / 1e6 * F.col("usd_in") + F.col("output_tokens") / 1e6 * F.col("usd_out")
    missing = F.raise_error(F.concat(F.lit("no price for "), F.coalesce("model_id", F.lit("null")), F.lit(" at "), F.coalesce(F.col(provider), F.lit("null")))).cast("double") if strict else F.lit(None).cast("double")
    return calls.join(p, on, "left").withColumn("usd", F.when(free, 0.0).when(F.col("usd_in").isNull(), missing).otherwise(usd)).drop("_m", "_p", "usd_in", "usd_out")


def tally(df: DataFrame, *keys) -> DataFrame:
    """Calls, tokens and USD by keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("usd").alias("usd"))


def by_purpose(calls: DataFrame) -> DataFrame:
    return tally(calls, "run_id", "model_id", "condition_id", "task_id", "call_purpose")


def by_day(calls: DataFrame, provider: str = "openrouter_provider") -> DataFrame:
    """Billed calls only: those without tokens reached no provider."""
    return tally(calls.where("input_tokens > 0 or output_tokens > 0"), F.substring("timestamp", 1, 10).alias("day"), "model_id", provider)


def with_totals(rows: DataFrame, task: str = "task_id") -> DataFrame:
    """Each row under its task and under the null task of the total; a row without a task only once."""
    return rows.withColumn(task, F.explode(F.array_distinct(F.array(F.col(task), F.lit(None).cast(rows.schema[task].dataType)))))


def by_generator(rows: DataFrame, models: list[str]) -> DataFrame:
    """``by_purpose`` rows under the model that generated in their run, by condition and task with totals."""
    maker = rows.where(F.col("model_id").isin(*models)).groupBy("run_id").agg(F.min("model_id").alias("generator"))
    return with_totals(rows.join(maker, "run_id")).groupBy("generator", "condition_id", "task_id", "call_purpose").agg(*[F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens", "usd")])


def candidates(calls: DataFrame) -> DataFrame:
    """Generator calls by run, condition and task."""
    return calls.where("call_purpose = 'generator'").groupBy("run_id", "condition_id", "task_id").agg(F.count("*").alias("candidates"))


def attributed(calls: DataFrame, keys: list[str], seq: str, task: str = "task_id") -> DataFrame:
    """Calls without a task belong to the next one in the log that has one; those after the last are dropped."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(0, Window.unboundedFollowing)
    return calls.withColumn(task, F.first(task, ignorenulls=True).over(w)).where(F.col(task).isNotNull())


def break_even(fixed_usd: Column, own: Column, base: Column) -> Column:
    """Tasks after which a fixed cost is paid back by the saving on each; null if nothing is saved."""
    return F.when(base - own > 0, fixed_usd / (base - own))


def per_pass(usd: Column, pass_rate: Column) -> Column:
    """Cost of a passing candidate, infinite if none passes."""
    return F.when(pass_rate > 0, usd / pass_rate).otherwise(F.lit(float("inf")))


def index_cost(batches: DataFrame) -> DataFrame:
    """Tokens of embedding batches by kind; a batch that several rows name counts once."""
    return batches.dropDuplicates(["batch_id"]).groupBy("kind").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.median("size").alias("median_size"))


def unpriced(calls: DataFrame) -> DataFrame:
    """Calls by day with priced and unpriced ones apart (``priced(strict=False)`` before)."""
    return calls.groupBy(F.substring("timestamp", 1, 10).alias("day")).agg(F.sum("usd").alias("usd"), F.count_if(F.col("usd").isNull()).alias("unpriced_calls"), F.sum(F.when(F.col("usd").isNull(), F.col("input_tokens") + F.col("output_tokens"))).alias("unpriced_tokens"))


def usage_buckets(calls: DataFrame) -> DataFrame:
    """Usage in total (level 3), by stage (1) and by prompt (2), as grouping sets in one pass. Only calls that reached the API have tokens and time."""
    api = ~F.coalesce("cache_hit", F.lit(False))
    over = lambda c: F.coalesce(F.sum(F.when(api, F.coalesce(c, F.lit(0)))), F.lit(0))
    fields = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    return calls.groupingSets([[], ["stage"], ["prompt_id"]], "stage", "prompt_id").agg(
        F.grouping_id().alias("level"), F.count_if(api).alias("calls_api"), F.count_if(~api).alias("calls_cache_hit"), F.count_if(api & F.col("error").isNotNull()).alias("calls_failed"),
        over("attempts").alias("api_attempts"), *[over(f"usage.{f}").alias(f) for f in fields], F.bround(over("latency_ms") / 1000, 3).alias("api_latency_s"),
    )


def is_complete(buckets: DataFrame, resumed: int) -> DataFrame:
    """The total with whether it may be quoted as a run's cost: nothing came from a cache, no file was resumed."""
    return buckets.where("level = 3").withColumn("complete", (F.col("calls_cache_hit") == 0) & F.lit(resumed == 0))


def with_missing(rows: DataFrame, column: str, values: list) -> DataFrame:
    """``rows`` with a row of nulls for each of the values that has none."""
    spark = rows.sparkSession
    return spark.createDataFrame([(v,) for v in values], f"{column} {rows.schema[column].dataType.simpleString()}").join(rows, column, "left")
