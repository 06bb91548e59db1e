"""Whole retrievals: anchors resolved, a template chosen by task type, its context assembled, cut and rendered; and what they are measured by."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators import context, resolve, templates
from graphloom.operators.graph import Graph
from graphloom.operators.rank import BUDGET
from graphloom.schemas import ANCHORS
from graphloom.sources.store import written


def graph_contexts(graph: Graph, corpus: DataFrame, requests: DataFrame, task_type: str, asked_routes: list[str] | None = None, hardened: bool = False, limit: int = 40, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Contexts (``project_id, task_type, assembly, tokens, context, fallback``) and resolutions of requests of one task type.

    Requests: ``request_id, project_id, requested`` (an anchor name) and optionally ``spec``, one task a project. Strict names must match exactly; hardened
    ones go down the resolution ladder, and a project none of whose anchors resolve gets the overview of its largest components.

    Each step is written before the next one reads it: templates join frames of one graph many times, and a plan that nested one in another would
    keep the analyzer busy for longer than the work takes."""
    nodes = graph.nodes.where(F.col("label").isin(*ANCHORS))
    if hardened:
        found = resolve.resolve_anchors(requests, nodes)
    else:
        known = nodes.select("project_id", F.col("name").alias("requested")).distinct().withColumn("name", F.col("requested"))
        found = resolve.resolve_strictly(requests, nodes).join(known, ["project_id", "requested"], "left")
    found = written(found)
    names = found.where("name is not null").select("project_id", "name").distinct()
    rows = written(templates.DISPATCH[task_type](graph, names))
    callers = written(templates.caller_props(graph, names)) if task_type == "refactoring" else None
    routes = written(templates.routing_table(graph)) if task_type == "feature_addition" else None
    near = written(templates.neighbor_props(graph, context.neighbour_uids(rows)))
    built = context.assemble(rows, corpus, task_type, near, callers, routes, asked_routes, budget).withColumn("task_type", F.lit(task_type))
    out = context.render(built).withColumn("fallback", F.lit(False))
    if hardened:
        lost = found.select("project_id").distinct().join(names, "project_id", "left_anti")
        top = context.overview(written(templates.project_overview(graph, limit, projects=written(lost))), budget)
        out = out.unionByName(context.render(_overview(top).withColumn("task_type", F.lit(task_type))).withColumn("fallback", F.lit(True)))
    return out, found


def _overview(top: DataFrame) -> DataFrame:
    """An overview as an assembly of neighbours only."""
    plain = lambda c: context.named(F.transform(c, lambda n: F.struct(n.alias("name"))), "name")
    entry = lambda e: F.struct(F.lit("project_overview").alias("role"), e["componentName"].alias("name"), e["filePath"].alias("file_path"), plain(e["propNames"]).alias("props"), plain(e["stateNames"]).alias("state_variables"))
    none = context.empty(f"array<{context.PART}>")
    made = F.struct(none.alias("anchors"), none.alias("secondary"), F.transform("entries", entry).cast(f"array<{context.NEIGHBOUR}>").alias("neighbours"), F.array("note").alias("kept_notes"), context.empty("array<string>").alias("droppable_notes"))
    assembled = top.select("project_id", made.cast(context.ASSEMBLY).alias("assembly"))
    return assembled.withColumn("tokens", context.estimate(F.col("assembly")))


def with_budgets(tasks: DataFrame, budgets: DataFrame) -> DataFrame:
    """Tasks with the ``budget`` set for each; a task without one fails the query."""
    missing = F.raise_error(F.concat(F.lit("no budget for "), F.col("task_id"))).cast("int")
    return tasks.join(budgets.select("task_id", "budget"), "task_id", "left").withColumn("budget", F.coalesce("budget", missing))


def matched_budgets(runs: DataFrame) -> DataFrame:
    """``task_id, budget`` where all runs of a task used the same number of tokens; others fail the query."""
    seen = runs.groupBy("task_id").agg(F.collect_set("tokens").alias("t"))
    return seen.select("task_id", F.when(F.size("t") == 1, F.element_at("t", 1)).otherwise(F.raise_error(F.concat(F.lit("several budgets for "), F.col("task_id"))).cast("bigint")).alias("budget"))


def recall(retrieved: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Wanted files that were retrieved, by keys and task. Retrieved: ``task_id, files`` and keys; wanted: ``task_id, targets``."""
    kept = F.size(F.array_intersect("files", "targets"))
    return retrieved.join(wanted, "task_id").groupBy("task_id", *keys).agg(F.sum(kept).alias("kept"), F.sum(F.size("targets")).alias("wanted"))


def strata(items: DataFrame, scope) -> DataFrame:
    """``project_id, path, stratum``: whether a file holds any item of the scope (a condition)."""
    return items.groupBy("project_id", "path").agg(F.when(F.bool_or(scope), "items").otherwise("empty").alias("stratum"))


def coverage_table(covered: DataFrame, sampled: DataFrame) -> DataFrame:
    """By type: the files that show it, and those of them in the sample."""
    files = covered.select("project_id", "path", F.explode("types").alias("type")).join(sampled.select("project_id", "path", F.lit(True).alias("_in")), ["project_id", "path"], "left")
    return files.groupBy("type").agg(F.count("*").alias("files"), F.sort_array(F.collect_list(F.when(F.col("_in"), F.concat_ws("/", "project_id", "path")))).alias("sampled"))


def throttle(limits: dict[str, float], per_call: dict[str, float], safety: float = 0.8) -> dict[str, float]:
    """Calls a minute that each limit allows, and the delay between calls that the tightest one asks for."""
    rates = {k: limits[k] * safety / per_call[k] for k in limits if per_call.get(k)}
    slowest = min(rates.values(), default=float("inf"))
    return rates | {"delay_s": 0.0 if slowest == float("inf") else 60 / slowest}
