"""Graded outcomes, timing, agreement, apply-loss and the gates that reports rest on."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The stages of a harness run and their outcome.
STAGE_OUTCOME = {
    "diff_apply_fail": "never_applied",
    "timeout_at_apply": "never_applied",
    "install_fail": "build_fail",
    "build_fail": "build_fail",
    "setup_crash": "build_fail",
    "timeout_at_install": "build_fail",
    "timeout_at_build": "build_fail",
    "test_fail": "test_fail",
    "timeout_at_test": "test_fail",
    "test_pass": "passed",
    "harness_error": "harness_error",
}
SCALE = ("passed", "test_fail", "build_fail", "never_applied")
OUTCOMES = (*SCALE, "quarantined", "harness_error")
VERIFIED_MODES = ("strict", "recount", "exact_unique", "whole_file")
QUARANTINED_MODES = ("recount_c0", "whole_file_elided")


def outcome(stage: Column, mode: Column, verified: Sequence[str] = VERIFIED_MODES, quarantined: Sequence[str] = QUARANTINED_MODES) -> Column:
    """The outcome of a result; null where stage and mode contradict each other."""
    table = F.create_map(*[F.lit(x) for pair in STAGE_OUTCOME.items() for x in pair])
    graded = F.try_element_at(table, stage)
    applied = graded.isin("passed", "test_fail", "build_fail")
    return (
        F.when(graded == "harness_error", graded).when(F.coalesce(mode.isin(*quarantined), F.lit(False)), F.lit("quarantined"))
        .when(applied & ~F.coalesce(mode.isin(*verified), F.lit(False)), F.lit(None).cast("string")).when((graded == "never_applied") & mode.isNotNull(), F.lit(None).cast("string")).otherwise(graded)
    )


def graded(results: DataFrame, strict: bool = True) -> DataFrame:
    """``results`` with ``outcome``. A contradiction fails the query if ``strict``."""
    found = outcome(F.col("stage"), F.col("apply_mode"))
    if strict:
        found = F.when(found.isNull(), F.raise_error(F.concat(F.col("candidate_id"), F.lit(": stage "), "stage", F.lit(" with mode "), F.coalesce("apply_mode", F.lit("null")))).cast("string")).otherwise(found)
    return results.withColumn("outcome", found)


def contradictions(results: DataFrame) -> DataFrame:
    return results.where(outcome(F.col("stage"), F.col("apply_mode")).isNull())


def outcome_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Counts of each outcome by keys."""
    return results.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("*").alias("n"))


def outcome_rollup(results: DataFrame, *keys: str) -> DataFrame:
    """As ``outcome_counts`` with the totals over each key from the right; ``level`` tells them apart from null keys."""
    return results.rollup(*keys).agg(F.grouping_id().alias("level"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("*").alias("n"))


def verified_pass(stage: Column, mode: Column) -> Column:
    return (stage == "test_pass") & F.coalesce(mode.isin(*VERIFIED_MODES), F.lit(False))


def condition_summary(results: DataFrame) -> DataFrame:
    """By condition and by condition and task: candidates, verified and unverified passes, quarantined, harness errors, distinct outputs, mean tokens."""
    sums = [
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(verified_pass(F.col("stage"), F.col("apply_mode"))).alias("passed"),
        F.count_if((F.col("stage") == "test_pass") & ~verified_pass(F.col("stage"), F.col("apply_mode"))).alias("unverified_passes"),
        F.count_if(F.col("apply_mode").isin(*QUARANTINED_MODES)).alias("quarantined"), F.count_if(F.col("stage") == "harness_error").alias("harness_errors"),
    ]
    if "output" in results.columns:
        sums.append(F.countDistinct(F.sha2("output", 256)).alias("distinct_outputs"))
    if "tokens" in results.columns:
        sums.append(F.bround(F.avg("tokens"), 0).alias("mean_tokens"))
    return results.groupingSets([["condition"], ["condition", "task_id"]], "condition", "task_id").agg(*sums)


def stage_matrix(results: DataFrame) -> DataFrame:
    return results.groupBy("task_id", "condition", "stage", "apply_mode").agg(F.count("*").alias("n"))


def timing(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Runs, least, greatest and median."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("greatest"))


def timing_of_repeats(df: DataFrame, value: str, repeat: str, *keys: str, warm_up: str | None = None) -> DataFrame:
    """The median over repetitions of what all queries of a repetition take together."""
    kept = df.where(~F.col(warm_up)) if warm_up else df
    return timing(kept.groupBy(*keys, repeat).agg(F.sum(value).alias(value)), value, *keys)


def measured(spark: SparkSession, steps: dict[str, Callable[[], DataFrame]], repeats: int = 3) -> DataFrame:
    """``step, repeat, seconds, rows`` of each step run whole, over and over: what ``timing_of_repeats`` sums up for loads, indexes and rankings."""
    rows = []
    for repeat in range(repeats):
        for name, step in steps.items():
            began = time.perf_counter()
            n = step().count()
            rows.append((name, repeat, time.perf_counter() - began, n))
    return spark.createDataFrame(rows, "step string, repeat int, seconds double, rows bigint")


def timeouts(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Three times the 95th percentile, rounded up."""
    p = F.percentile(value, F.lit(0.95))
    return df.groupBy(*keys).agg(p.alias("p95"), F.ceil(3 * p).cast("bigint").alias("timeout"))


def weighted_median(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """The median of values that each occur ``weight`` times."""
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5), F.col(weight)).alias("median"))


def precision_recall(df: DataFrame) -> DataFrame:
    """``df`` (``tp, fp, fn``) with ``precision, recall, f1``; null where nothing divides."""
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def kappa(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Agreement of two truth-value columns: items, agreements and Cohen's kappa (1 where chance alone agrees fully, null without items)."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = both.groupBy(*keys).agg(
        F.count("*").alias("items"), F.count_if(F.col(a) == F.col(b)).alias("agree"), F.avg(F.col(a).cast("int")).alias("_a"), F.avg(F.col(b).cast("int")).alias("_b")
    )
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    seen = F.try_divide(F.col("agree"), F.col("items"))
    return sums.withColumn("kappa", F.when(F.col("items") > 0, F.when(chance == 1, 1.0).otherwise(F.try_divide(seen - chance, 1 - chance)))).drop("_a", "_b")


def micro_average(df: DataFrame, *keys: str) -> DataFrame:
    """Precision and recall of sets that a classifier named, each weighted by the calls that named it (``wanted, got`` arrays, ``calls``)."""
    hit = F.size(F.array_intersect("wanted", "got"))
    sums = df.groupBy(*keys).agg(
        F.sum(hit * F.col("calls")).alias("tp"), F.sum((F.size(F.array_distinct("got")) - hit) * F.col("calls")).alias("fp"), F.sum((F.size(F.array_distinct("wanted")) - hit) * F.col("calls")).alias("fn")
    )
    return precision_recall(sums)


def apply_loss(df: DataFrame, *keys: str) -> DataFrame:
    """Scripts that applied, partly would have and substantively would have; edits kept and in all. Rows: ``edits``, ``replay``."""
    accepted = F.transform("replay.accepted", lambda i: F.element_at("edits", i + 1))
    real = F.exists(accepted, lambda e: e["op"].isin("replace", "delete"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("replay.would_apply")).alias("never_applied"), F.count_if(F.col("replay.partial")).alias("partial"),
        F.count_if(F.col("replay.partial") & real).alias("substantive"), F.sum(F.size("replay.accepted")).alias("edits_kept"), F.sum(F.size("edits")).alias("edits"),
    )


def witnessed_solutions(passing: DataFrame) -> DataFrame:
    """``task_id, solution, witness``: the distinct sets of files that passing candidates edited, without those they created. Rows: ``candidate_id, seq, edited, created``."""
    files = F.array_sort(F.array_except(F.array_distinct("edited"), F.coalesce("created", F.array().cast("array<string>"))))
    return passing.withColumn("solution", files).groupBy("task_id", "solution").agg(F.min_by("candidate_id", "seq").alias("witness"))


def sufficient(retrieved: DataFrame, solutions: DataFrame) -> DataFrame:
    """``retrieved`` (``task_id, files``) with the least witnessed solution that its files contain, null if none. Solutions are few a task."""
    keyed = retrieved.withColumn("_files", F.array_sort("files"))
    fits = keyed.select("task_id", "_files").distinct().join(solutions, "task_id").where(F.size(F.array_except("solution", "_files")) == 0)
    best = fits.groupBy("task_id", "_files").agg(F.min_by("solution", F.struct(F.size("solution"), F.col("solution"))).alias("solution"))
    return keyed.join(best, ["task_id", "_files"], "left").select(*retrieved.columns, "solution")


def with_replays(published: DataFrame, replays: DataFrame, *keys: str) -> DataFrame:
    """Published passes and the ones that replayed scripts add."""
    extra = replays.groupBy(*keys).agg(F.sum(F.col("passed").cast("int")).alias("extra"))
    return published.join(extra, list(keys), "left").withColumn("extra", F.coalesce("extra", F.lit(0))).withColumn("counterfactual", F.col("passes") + F.col("extra"))


def candidate_matrix(tasks: DataFrame, conditions: DataFrame, replicates: int) -> DataFrame:
    """Every task under every condition, ``replicates`` times; all three are short design tables."""
    grid = tasks.select("task_id").crossJoin(conditions.select("condition")).crossJoin(tasks.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate")))
    return grid.withColumn("candidate_id", F.format_string("%s__%s__n%d", "task_id", "condition", "replicate"))


# Gates: each gives the rows that break a rule, none if it holds.


def gaps(rows: DataFrame, grid: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Cells of the grid that do not have the expected number of rows."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return grid.select(*keys).distinct().join(n, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") != expected)


def missing_artifacts(listing: DataFrame, candidates: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required files that a candidate lacks or has empty. Listing: ``candidate_id, name, size``."""
    wanted = candidates.select("candidate_id", F.explode(F.array(*map(F.lit, required))).alias("name"))
    return wanted.join(listing, ["candidate_id", "name"], "left").where("size is null or size = 0").withColumn("problem", F.when(F.col("size").isNull(), "missing").otherwise("empty")).drop("size")


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that only one side has, or that have other values: ``missing`` on the left, ``extra`` there, or ``wrong``."""
    a, b = (df.select(*keys, F.col(value).alias(f"{side}_{value}"), F.lit(True).alias(f"_{side}")) for df, side in ((left, "left"), (right, "right")))
    both = a.join(b, list(keys), "full_outer")
    kind = F.when(F.col("_left").isNull(), "missing").when(F.col("_right").isNull(), "extra").when(~F.col(f"left_{value}").eqNullSafe(F.col(f"right_{value}")), "wrong")
    return both.withColumn("kind", kind).where("kind is not null").drop("_left", "_right")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks."""
    return left.join(right, left.columns, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, left.columns, "left_anti").withColumn("side", F.lit("right")))


def not_one_value(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Groups in which a value is not the same for all rows."""
    return df.groupBy(*keys).agg(F.collect_set(value).alias("values")).where(F.size("values") != 1)


def over_budget(df: DataFrame, tokens: str, budget: str) -> DataFrame:
    """Contexts that are empty or exceed their budget."""
    return df.where((F.col(tokens) > F.col(budget)) | (F.col(tokens) <= 0))


def sums_differ(df: DataFrame, key: str, value: str, total: str = "all") -> DataFrame:
    """Where the parts do not add up to the row of the total."""
    sums = df.agg(F.sum(F.when(F.col(key) != total, F.col(value))).alias("parts"), F.sum(F.when(F.col(key) == total, F.col(value))).alias("total"))
    return sums.where(~F.col("parts").eqNullSafe(F.col("total")))


def not_contained(texts: DataFrame, text: str, claims: DataFrame, claim: str) -> DataFrame:
    """Claims that no text contains; both are short report tables."""
    return claims.join(texts.select(F.col(text).alias("_text")), F.contains(F.col("_text"), F.col(claim)), "left_anti")


def constants_differ(found: dict[str, int], expected: dict[str, int]) -> dict[str, tuple]:
    return {k: (found.get(k), v) for k, v in expected.items() if found.get(k) != v}


def require_empty(df: DataFrame, message: str) -> None:
    """Raises with the first rows of a gate's result."""
    if rows := df.limit(5).collect():
        raise AssertionError(f"{message}: {rows}")


def rate_limits(calls: DataFrame) -> DataFrame:
    """By header: its distinct limits and the least that remained. Header names compare without case."""
    headers = calls.where("rate_limit is not null").select(F.explode(F.transform_keys("rate_limit", lambda k, _: F.lower(k))).alias("header", "value"))
    number = headers.select(F.regexp_extract("header", r"(?:x-)?(?:anthropic-)?ratelimit-(.*)$", 1).alias("name"), F.expr("try_cast(value as bigint)").alias("n")).where("name != ''")
    kind = number.withColumn("resource", F.regexp_replace("name", r"-?(limit|remaining|reset)-?", "")).withColumn("kind", F.regexp_extract("name", r"(limit|remaining)", 1))
    return kind.groupBy("resource").agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "limit", F.col("n")))).alias("limits"), F.min(F.when(F.col("kind") == "remaining", F.col("n"))).alias("least_remaining"))


def call_counts(calls: DataFrame) -> DataFrame:
    """Calls by purpose, model and provider, and how many failed."""
    return calls.groupBy("call_purpose", "model_id", "openrouter_provider").agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def distinct_results(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """How often each result came up."""
    return df.groupBy(*keys, value.alias("result")).agg(F.count("*").alias("n"))


def reasons(df: DataFrame, reason: str, *keys: str) -> DataFrame:
    """Reasons by how often they occur, then by name."""
    n = df.where(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), reason) if keys else Window.orderBy(F.desc("n"), reason)))


def examples(df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 5) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def stage_of_flags(df: DataFrame) -> DataFrame:
    """``df`` with ``stage`` from the marks a run left (``marks``, an array of names, and ``timed_out``): the first step without its mark failed."""
    has = lambda name: F.array_contains("marks", name)
    steps = (("apply", "diff_apply_fail"), ("install", "install_fail"), ("build", "build_fail"), ("test", "test_fail"))
    stage = F.lit("test_pass")
    for step, failed in reversed(steps):
        stage = F.when(has(f"{step}_ok"), stage).otherwise(F.when(F.col("timed_out"), f"timeout_at_{step}").otherwise(failed))
    return df.withColumn("stage", F.when(has("setup_crash"), "setup_crash").otherwise(stage))


def orchestrator_errors(planned: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """Results with a row of stage ``harness_error`` for each planned candidate that failed before it ran."""
    failed = planned.join(results, "candidate_id", "left_anti").join(errors, "candidate_id").withColumn("stage", F.lit("harness_error")).withColumnRenamed("message", "stage_detail")
    return results.unionByName(failed.select(*[c for c in failed.columns if c in results.columns]), allowMissingColumns=True)


def run_summary(spark: SparkSession, results: DataFrame) -> DataFrame:
    return results.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("stage") == "harness_error").alias("harness_errors"), F.count_if(F.col("stage") == "test_pass").alias("test_passes"))
