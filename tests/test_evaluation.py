import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from graphloom.operators import annotations, cost, evaluation


@pytest.mark.parametrize("stage,mode,outcome", [
    *[(s, None if o == "never_applied" else "strict", o) for s, o in evaluation.STAGE_OUTCOME.items() if o != "harness_error"],
    ("harness_error", None, "harness_error"), ("test_pass", "recount_c0", "quarantined"), ("diff_apply_fail", "whole_file_elided", "quarantined"),
    ("test_pass", None, None), ("test_pass", "odd", None), ("diff_apply_fail", "strict", None), ("no_such_stage", "strict", None),
])
def test_outcomes(spark, stage, mode, outcome):
    df = spark.createDataFrame([("c", stage, mode)], "candidate_id string, stage string, apply_mode string")
    assert evaluation.graded(df, strict=False).first().outcome == outcome
    assert evaluation.contradictions(df).count() == (outcome is None)
    if outcome is None:
        with pytest.raises(Exception, match="stage"):
            evaluation.graded(df).collect()


def test_numbers(spark):
    r = random.Random(4)
    values = [r.random() * 100 for _ in range(31)]
    df = spark.createDataFrame([("k", v, r.randrange(1, 5)) for v in values], "k string, v double, w int")
    rows = df.collect()
    t = evaluation.timing(df, "v", "k").first()
    assert (t.n, t.least, t.greatest) == (31, min(values), max(values)) and t.median == pytest.approx(statistics.median(values))
    ordered = sorted(values)
    at = 0.95 * 30
    p95 = ordered[int(at)] + (at - int(at)) * (ordered[int(at) + 1] - ordered[int(at)])
    out = evaluation.timeouts(df, "v", "k").first()
    assert out.p95 == pytest.approx(p95) and out.timeout == math.ceil(3 * p95)
    repeated = [x.v for x in rows for _ in range(x.w)]
    assert evaluation.weighted_median(df, "v", "w", "k").first().median == pytest.approx(statistics.median(repeated))


@pytest.mark.parametrize("tp,fp,fn,want", [(3, 1, 2, (0.75, 0.6, 2 / 3)), (0, 0, 2, (None, 0.0, None)), (0, 1, 0, (0.0, None, None)), (0, 1, 1, (0.0, 0.0, None)), (0, 0, 0, (None, None, None))])
def test_precision_and_recall(spark, tp, fp, fn, want):
    row = evaluation.precision_recall(spark.createDataFrame([(tp, fp, fn)], "tp int, fp int, fn int")).first()
    assert [row.precision, row.recall, row.f1] == [None if w is None else pytest.approx(w) for w in want]


@pytest.mark.parametrize("pairs,want", [([(True, True), (False, False)], 1.0), ([(True, True)] * 3, 1.0), ([(True, False), (False, True)], -1.0), ([(True, True), (True, False), (False, False), (False, False)], 0.5)])
def test_kappa(spark, pairs, want):
    assert evaluation.kappa(spark.createDataFrame(pairs, "a boolean, b boolean"), "a", "b").first().kappa == pytest.approx(want)


def test_gates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, v int")
    grid = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted((r.k, r.n) for r in evaluation.gaps(rows, grid, ["k"], 2).collect()) == [("b", 1), ("c", 0)]
    left, right = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "i int, v string"), spark.createDataFrame([(2, None), (3, "y"), (4, "w")], "i int, v string")
    assert sorted((r.i, r.kind) for r in evaluation.differences(left, right, ["i"], "v").collect()) == [(1, "extra"), (3, "wrong"), (4, "missing")]
    listing = spark.createDataFrame([("c", "a.json", 3), ("c", "b.json", 0)], "candidate_id string, name string, size int")
    gone = evaluation.missing_artifacts(listing, spark.createDataFrame([("c",)], "candidate_id string"), ["a.json", "b.json", "d.json"])
    assert sorted((r.name, r.problem) for r in gone.collect()) == [("b.json", "empty"), ("d.json", "missing")]
    assert evaluation.not_one_value(rows, ["k"], F.col("v")).count() == 0
    assert evaluation.sums_differ(spark.createDataFrame([("all", 3), ("x", 1), ("y", 2)], "k string, v int"), "k", "v").count() == 0
    with pytest.raises(AssertionError):
        evaluation.require_empty(rows, "rows")
    flags = spark.createDataFrame([(["apply_ok", "install_ok", "build_ok", "test_ok"], False), (["apply_ok"], True), ([], False), (["setup_crash"], False)], "marks array<string>, timed_out boolean")
    assert [r.stage for r in evaluation.stage_of_flags(flags).collect()] == ["test_pass", "timeout_at_install", "diff_apply_fail", "setup_crash"]


def test_solutions(spark):
    passing = spark.createDataFrame([("c2", "t", 2, ["b", "a", "new"], ["new"]), ("c1", "t", 1, ["a", "b"], None), ("c3", "t", 3, ["a"], None)], "candidate_id string, task_id string, seq int, edited array<string>, created array<string>")
    found = evaluation.witnessed_solutions(passing)
    assert sorted((tuple(r.solution), r.witness) for r in found.collect()) == [(("a",), "c3"), (("a", "b"), "c1")]
    got = evaluation.sufficient(spark.createDataFrame([("t", ["a", "b", "x"]), ("t", ["b"])], "task_id string, files array<string>"), found)
    assert [r.solution for r in got.orderBy(F.size("files")).collect()] == [None, ["a"]]


def calls(spark, rows):
    kind = "run_id string, model_id string, openrouter_provider string, call_purpose string, condition_id string, task_id string, usage struct<input_tokens:bigint,output_tokens:bigint>, timestamp string"
    return cost.tokens(spark.createDataFrame(rows, kind))


def test_cost(spark):
    rows = [
        ("r", "anthropic/claude-sonnet-4-6", None, "generator", "kg", "P1", (1_000_000, 100_000), "2026-01-02T00:00:00"), ("r", "openrouter/qwen/qwen3-coder", "Google", "generator", "kg", "P1", (1_000_000, None), "2026-01-02T01:00:00"),
        ("r", "text-embedding-3-large", None, "embedding", "kg", None, (2_000_000, 0), "2026-01-03T00:00:00"), ("r", "mock", None, "generator", "kg", "P1", (0, 0), "2026-01-03T00:00:00"),
    ]
    priced = cost.priced(calls(spark, rows), cost.price_table(spark))
    assert sorted(round(r.usd, 6) for r in priced.collect()) == [0.0, 0.22, 0.26, 4.5]
    days = {(r.day, r.model_id): r.calls for r in cost.by_day(priced).collect()}
    assert days == {("2026-01-02", "anthropic/claude-sonnet-4-6"): 1, ("2026-01-02", "openrouter/qwen/qwen3-coder"): 1, ("2026-01-03", "text-embedding-3-large"): 1}
    totals = {(r.task_id, r.call_purpose): r.calls for r in cost.tally(cost.with_totals(cost.by_purpose(priced).withColumn("usd", F.col("usd"))), "task_id", "call_purpose").collect()}
    assert totals == {("P1", "generator"): 3, (None, "generator"): 3, (None, "embedding"): 1}
    with pytest.raises(Exception, match="no price"):
        cost.priced(calls(spark, [("r", "unknown", None, "generator", "kg", "P1", (1, 1), "2026")]), cost.price_table(spark)).collect()
    apart = cost.unpriced(cost.priced(calls(spark, [("r", "unknown", None, "generator", "kg", "P1", (1, 1), "2026-01-01")]), cost.price_table(spark), strict=False)).first()
    assert (apart.unpriced_calls, apart.unpriced_tokens) == (1, 2)
    assert [r.n for r in spark.range(1).select(cost.break_even(F.lit(10.0), F.lit(1.0), F.lit(3.0)).alias("n")).collect()] == [5.0]
    assert spark.range(1).select(cost.break_even(F.lit(10.0), F.lit(3.0), F.lit(1.0)).alias("n")).first().n is None
    assert spark.range(1).select(cost.per_pass(F.lit(1.0), F.lit(0.0)).alias("n")).first().n == math.inf


def test_usage_and_attribution(spark):
    kind = "stage string, prompt_id string, cache_hit boolean, attempts int, usage struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>, error struct<error_type:string,message:string>, latency_ms double"
    rows = [("per_file", "a", False, 2, (10, 1, 0, None), None, 1500.0), ("per_file", "b", True, 0, (99, 9, 9, 9), None, 9.0), ("cross", "a", False, 1, (5, 1, 1, 0), ("E", "m"), 500.0)]
    got = {(r.level, r.stage, r.prompt_id): r for r in cost.usage_buckets(spark.createDataFrame(rows, kind)).collect()}
    total = got[3, None, None]
    assert (total.calls_api, total.calls_cache_hit, total.calls_failed, total.api_attempts, total.input_tokens, total.api_latency_s) == (2, 1, 1, 3, 15, 2.0)
    assert got[1, "per_file", None].calls_cache_hit == 1 and got[2, None, "a"].calls_api == 2 and len(got) == 5
    log = spark.createDataFrame([("r", 1, None), ("r", 2, "t1"), ("r", 3, None), ("r", 4, None), ("r", 5, "t2"), ("r", 6, None)], "run string, seq int, task_id string")
    assert {r.seq: r.task_id for r in cost.attributed(log, ["run"], "seq").collect()} == {1: "t1", 2: "t1", 3: "t2", 4: "t2", 5: "t2"}


def annotated(status="done", items=("[y] N Function_Component:App", "[n] N Prop:App::a # cause: llm", "[?] E USES_COMPONENT Function_Component:App -> Function_Component:Row@src/Row.tsx"), missed=("N Prop:App::b", "N Prop:Row::c@src/Row.tsx", "N Prop:App::a", "N Prop:App::b")):
    return "\n".join(["# t", "<!-- wp6 v1 project=shop path=src/App.tsx sha=1 graph=g prompt_set=p -->", f"status: {status}", "annotator: me", annotations.MARKS["items"][0], "### group", *[f"- {i}" for i in items], annotations.MARKS["items"][1], annotations.MARKS["missed"][0], "> help", *missed, annotations.MARKS["missed"][1]])


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.md").write_text(annotated())
    (tmp_path / "b.md").write_text(annotated(status="todo"))
    parsed = annotations.read_files(spark, str(tmp_path))
    scored = annotations.score(parsed).cache()
    kinds = sorted((r.kind, r["item"].src.name) for r in scored.collect())
    assert kinds == [("conflict", "a"), ("fn", "b"), ("fp", "a"), ("set_aside", "c"), ("tp", "App"), ("unsure", "App")]
    counts = {(r.scope, r.group_kind, r.type): r for r in annotations.score_counts(scored).collect()}
    assert (counts["llm", "all", "*"].tp, counts["llm", "all", "*"].fp, counts["llm", "all", "*"].fn, counts["llm", "repo", "Prop"].fn) == (1, 1, 1, 1)
    assert [(r.kind, r.type, r.cause) for r in annotations.causes(scored).orderBy("kind").collect()] == [("FN", "Prop", None), ("FP", "Prop", "llm")]
    both = annotations.agreement(scored, scored).first()
    assert (both["items"], both.agree, both.kappa, both.missed_both) == (2, 2, 1.0, 1)


@pytest.mark.parametrize("line", ["X", "N", "N Nope:a", "N File:a", "N Prop:a", "N Library_Hook:useState", "N Library:react@x", "E USES A -> B", "E PASSES_PROP Function_Component:A -> Function_Component:B", "E USES_COMPONENT Function_Component:A -> Function_Component:B prop=x", "N 'open"])
def test_bad_items(line):
    with pytest.raises(annotations.ItemError):
        annotations.parse_item(line, "f.tsx")


def test_rendered_files_parse_and_samples_repeat():
    text = annotations.render("shop", "src/App.tsx", "s", "g", "p", "line one\nline two", "tsx", {"nodes": ["N Function_Component:App"], "edges": []})
    got = annotations.parse_file(text)
    assert (got["project"], got["path"], got["status"], len(got["decisions"]), got["errors"]) == ("shop", "src/App.tsx", "todo", 1, [])
    types = {"p": {"a": {"X"}, "b": {"X", "Y"}, "c": set(), "d": {"X"}}}
    first = annotations.sample(types, {"p": 3}, 7, ["p"], {"p": {"c"}}, 1)
    assert first == annotations.sample(types, {"p": 3}, 7, ["p"], {"p": {"c"}}, 1) and len(first) == 3
    assert ("p", "b", "covers Y") in first and ("p", "c", "fill: no LLM items") in first


def test_measured_steps(spark):
    ran = []
    got = evaluation.measured(spark, {"load": lambda: ran.append("load") or spark.range(5), "rank": lambda: spark.range(2)}, repeats=2)
    assert sorted((r.step, r.repeat, r["rows"]) for r in got.collect()) == [("load", 0, 5), ("load", 1, 5), ("rank", 0, 2), ("rank", 1, 2)] and len(ran) == 2
    assert evaluation.timing_of_repeats(got, "seconds", "repeat").first().n == 2
