"""Context assembly under a token budget: arrays of parts a request, removed step by step in a fixed order until the estimate fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.text import token_estimate
from graphloom.operators.rank import BUDGET

NAMED = "array<struct<name:string,type:string,isRequired:boolean,source:string,filePath:string,defaultValue:string>>"
PART = f"struct<name:string,file_path:string,component_type:string,source_code:string,props:{NAMED},hooks:{NAMED},state_variables:{NAMED},contexts_consumed:array<string>>"
NEIGHBOUR = f"struct<role:string,name:string,file_path:string,props:{NAMED},state_variables:{NAMED}>"
ASSEMBLY = f"struct<anchors:array<{PART}>,secondary:array<{PART}>,neighbours:array<{NEIGHBOUR}>,kept_notes:array<string>,droppable_notes:array<string>>"
# The words of notes and of neighbours' roles.
STOP_TOKENS = ("STOP", "[STOP]", "<STOP>")
ROLES = {"parent": "renders the target and passes props to it", "child": "is rendered by the target", "caller": "calls the target", "used_by": "calls this hook"}
OVERVIEW_NOTE = (
    "⚠ No anchor from the task statement resolved to a component or hook in the knowledge graph. The section below is a project-wide overview of the largest "
    "components, not context scoped to the task — treat it as orientation only."
)


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def named(entries: Column, *fields: str) -> Column:
    """Entries as NAMED structs, fields they lack as null."""
    wanted = [x.split(":")[0] for x in NAMED[len("array<struct<") : -2].split(",")]
    kinds = dict(x.split(":") for x in NAMED[len("array<struct<") : -2].split(","))
    return F.transform(entries, lambda e: F.struct(*[(e[f] if f in fields else F.lit(None)).cast(kinds[f]).alias(f) for f in wanted]))


def names(entries: Column, divider: str = " ") -> Column:
    return F.array_join(F.transform(entries, lambda e: F.coalesce(e["name"], F.lit(""))), divider)


def routing_notes(routes: Column) -> Column:
    """A heading and a line a route; nothing without routes."""
    flags = lambda r: F.concat_ws(", ", F.when(r["isNested"], "nested"), F.when(r["isProtected"], "protected"), F.when(r["isLazy"], "lazy"))
    none = F.lit("None")
    text = lambda c: F.coalesce(c, none)
    line = lambda r: F.concat(
        F.lit("  "), text(r["routePath"]), F.lit(" → "), text(r["targetComponent"]), F.lit(" ("), text(r["targetFile"]), F.lit("); router "), text(r["routerComponent"]), F.lit(" ("), text(r["routerFile"]), F.lit(")"),
        F.when(flags(r) != "", F.concat(F.lit(" ["), flags(r), F.lit("]"))).otherwise(F.lit("")),
    )
    return F.when(F.size(routes) > 0, F.concat(F.array(F.lit("Project routing table:")), F.transform(routes, line))).otherwise(empty("array<string>"))


def absent_route_notes(asked: Column, routes: Column) -> Column:
    """A warning for each route that is asked for and not in the table."""
    known = F.transform(routes, lambda r: r["routePath"])
    return F.transform(F.filter(asked, lambda a: ~F.coalesce(F.array_contains(known, a), F.lit(False))), lambda a: F.concat(F.lit("⚠ The spec references route '"), a, F.lit("' — not present in the routing table above.")))


def handler_note(component: Column, handlers: Column) -> Column:
    """One line with a component's handlers, null if it has none."""
    listed = F.array_join(F.transform(handlers, lambda h: F.concat(F.coalesce(h["eventType"], F.lit("?")), F.lit("→"), h["handlerName"])), ", ")
    return F.when(F.size(handlers) > 0, F.concat(component, F.lit(" event handlers: "), listed))


def context_notes(contexts: Column) -> Column:
    """A line for each consumed context whose provider is known."""
    return F.transform(
        F.filter(contexts, lambda c: c["providerName"].isNotNull()),
        lambda c: F.concat(F.lit("Context "), c["name"], F.lit(" is provided by "), c["providerName"], F.lit(" at "), F.coalesce(c["providerFile"], F.lit("?")), F.lit("; consumers may useContext("), c["name"], F.lit(") without prop-drilling.")),
    )


def caller_note(component: Column, callers: Column) -> Column:
    """The warning about callers (``name, passed``), null if there are none."""
    label = lambda c: F.when(F.size(c["passed"]) > 0, F.concat(c["name"], F.lit(" (props: "), F.array_join(c["passed"], ", "), F.lit(")"))).otherwise(c["name"])
    return F.when(
        F.size(callers) > 0,
        F.concat(F.lit("⚠ Refactoring "), component, F.lit("'s prop interface will require updating "), F.size(callers).cast("string"), F.lit(" caller(s): "), F.array_join(F.transform(callers, label), "; "), F.lit(".")),
    )


def estimate(a: Column) -> Column:
    """Tokens of an assembly: each part's estimate is rounded down before they are added."""
    total = lambda array, *texts: F.aggregate(array, F.lit(0).cast("bigint"), lambda s, x: s + sum((token_estimate(t(x)) for t in texts), F.lit(0)))
    part = (lambda p: p["source_code"], lambda p: names(p["props"]), lambda p: names(p["hooks"]), lambda p: names(p["state_variables"]), lambda p: F.array_join(p["contexts_consumed"], " "))
    near = (lambda n: F.concat_ws(" ", n["name"], n["file_path"]), lambda n: names(n["props"]), lambda n: names(n["state_variables"]))
    return total(F.concat(a["anchors"], a["secondary"]), *part) + total(a["neighbours"], *near) + total(F.concat(a["kept_notes"], a["droppable_notes"]), lambda t: t)


def _with(a: Column, **changes: Column) -> Column:
    fields = ("anchors", "secondary", "neighbours", "kept_notes", "droppable_notes")
    return F.struct(*[changes.get(f, a[f]).alias(f) for f in fields]).cast(ASSEMBLY)


def without_role(role: str) -> Callable[[Column], Column]:
    return lambda a: _with(a, neighbours=F.filter(a["neighbours"], lambda n: n["role"] != role))


def without(*fields: str) -> Callable[[Column], Column]:
    kinds = {"neighbours": f"array<{NEIGHBOUR}>", "secondary": f"array<{PART}>", "droppable_notes": "array<string>"}
    return lambda a: _with(a, **{f: empty(kinds[f]) for f in fields})


def bare_neighbours(a: Column) -> Column:
    return _with(a, neighbours=F.transform(a["neighbours"], lambda n: n.withField("props", empty(NAMED)).withField("state_variables", empty(NAMED))))


def bare_anchors(*fields: str) -> Callable[[Column], Column]:
    def step(a: Column) -> Column:
        def clear(p: Column) -> Column:
            for f in fields:
                p = p.withField(f, empty(NAMED))
            return p

        return _with(a, anchors=F.transform(a["anchors"], clear))

    return step


def both(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def step(a: Column) -> Column:
        for s in steps:
            a = s(a)
        return a

    return step


#: What goes first when a context exceeds its budget, by task type.
STEPS = {
    "bug_fix": (without_role("parent"), without("droppable_notes"), bare_neighbours, without_role("used_by"), bare_anchors("hooks", "state_variables"), bare_anchors("props"), without("secondary")),
    "feature_addition": (without("droppable_notes"), bare_neighbours, without("neighbours"), without("secondary")),
    "refactoring": (without_role("child"), both(bare_anchors("hooks", "state_variables"), without("droppable_notes")), without("secondary"), bare_neighbours, without("neighbours")),
}


def truncated(df: DataFrame, task_type: str, budget: int = BUDGET, column: str = "assembly") -> DataFrame:
    """``df`` with each assembly cut by the type's steps until its estimate fits; after the last step it stays as it is."""
    for step in STEPS.get(task_type, ()):
        df = df.withColumn(column, F.when(estimate(F.col(column)) <= budget, F.col(column)).otherwise(step(F.col(column))))
    return df.withColumn("tokens", estimate(F.col(column)))


def _sources(df: DataFrame, corpus: DataFrame, path: str, out: str) -> DataFrame:
    """``df`` with the body of the file at ``path``, null if the corpus lacks it."""
    return df.join(corpus.select(F.col("project_id"), F.col("path").alias(path), F.col("source").alias(out)), ["project_id", path], "left")


def _neighbour(rank: int, role: str) -> Callable[[Column], Column]:
    uid = lambda n: F.coalesce(n["uid"], F.concat(n["name"], F.lit("::"), n["filePath"]))
    return lambda n: F.struct(F.lit(rank).alias("rank"), F.lit(role).alias("role"), n["name"].alias("name"), n["filePath"].alias("file_path"), uid(n).alias("uid"))


def assemble(rows: DataFrame, corpus: DataFrame, task_type: str, neighbour_props: DataFrame | None = None, caller_props: DataFrame | None = None, routes: DataFrame | None = None, asked_routes: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
    """``project_id, assembly, tokens`` from a template's rows: one assembly a project, anchors with their source, the roles that the task type
    shows, hooks' sources once each, notes; then truncated. Corpus: ``project_id, path, source``."""
    has = lambda c: F.col(c) if c in rows.columns else empty("array<struct<name:string,type:string,isRequired:boolean,source:string,filePath:string,defaultValue:string,uid:string,providerName:string,providerFile:string,eventType:string,handlerName:string>>")
    props = ("name", "type", "isRequired")
    numbered = _sources(rows.withColumn("_at", F.struct("componentName", "filePath")), corpus, "filePath", "_source")
    hooks = F.concat(named(has("libraryHooks"), "name", "source"), named(has("customHooks"), "name", "filePath"))
    state = F.concat(named(has("stateVars"), "name", "type", "defaultValue"), named(has("classStateVars"), "name", "type", "defaultValue"))
    anchor = F.struct(
        F.col("componentName").alias("name"), F.col("filePath").alias("file_path"), F.col("componentType").alias("component_type"), F.col("_source").alias("source_code"),
        named(has("acceptedProps"), *props).alias("props"), hooks.alias("hooks"), state.alias("state_variables"), F.transform(has("consumedContexts"), lambda c: c["name"]).alias("contexts_consumed"),
    ).cast(PART)
    roles = {"bug_fix": (("directParents", "parent"), ("usedByComponents", "used_by")), "feature_addition": (("children", "child"),), "refactoring": (("callers", "caller"), ("children", "child"))}.get(task_type, ())
    near = F.concat(empty("array<struct<rank:int,role:string,name:string,file_path:string,uid:string>>"), *[
        F.transform(F.col(c), _neighbour(i, role)) for i, (c, role) in enumerate(roles)
    ])
    seen = numbered.select("project_id", "_at", F.posexplode(near).alias("pos", "n")).select("project_id", "_at", "pos", "n.*")
    if neighbour_props is not None:
        seen = seen.join(neighbour_props.select("project_id", "uid", named(F.col("props"), *props).alias("props"), named(F.col("stateVars"), "name", "type").alias("state_variables")), ["project_id", "uid"], "left")
    else:
        seen = seen.withColumns({"props": empty(NAMED), "state_variables": empty(NAMED)})
    passed = F.lit(0)
    if caller_props is not None:
        own = caller_props.select("project_id", F.col("componentName").alias("_c"), F.col("callerUid").alias("uid"), "propsPassed")
        seen = seen.join(own, (seen["project_id"] == own["project_id"]) & (seen["uid"] == own["uid"]) & (seen["_at.componentName"] == own["_c"]) & (seen["role"] == "caller"), "left").drop(own["project_id"], own["uid"], "_c")
        passed = F.when(F.col("role") == "caller", F.size(F.coalesce("propsPassed", empty("array<string>")))).otherwise(0)
    else:
        seen = seen.withColumn("propsPassed", empty("array<string>"))
    entry = F.struct("role", "name", "file_path", F.coalesce("props", empty(NAMED)).alias("props"), F.coalesce("state_variables", empty(NAMED)).alias("state_variables")).cast(NEIGHBOUR)
    near_lists = seen.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "rank", (-passed).alias("passed"), "pos", entry.alias("e")))), lambda x: x["e"]).alias("neighbours"))
    callers = seen.where("role = 'caller' and name is not null").groupBy("project_id", "_at").agg(F.sort_array(F.collect_list(F.struct((-passed).alias("passed_n"), F.col("pos"), F.col("name"), F.coalesce("propsPassed", empty("array<string>")).alias("passed")))).alias("_callers"))
    hook_column = {"bug_fix": "delegatedHooks", "feature_addition": "customHooks", "refactoring": "customHooks"}.get(task_type)
    noted = numbered.join(callers, ["project_id", "_at"], "left")
    kept = F.array_compact(F.array(caller_note(F.col("componentName"), F.coalesce("_callers", empty("array<struct<passed_n:int,pos:int,name:string,passed:array<string>>>"))))) if task_type == "refactoring" else empty("array<string>")
    drop = context_notes(has("consumedContexts")) if task_type == "feature_addition" else F.array_compact(F.array(handler_note(F.col("componentName"), has("eventHandlers")))) if task_type in ("bug_fix", "refactoring") else empty("array<string>")
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("_at", c.alias("v")))), lambda x: x["v"])
    tops = noted.groupBy("project_id").agg(in_order(anchor).alias("anchors"), F.flatten(in_order(kept)).alias("kept_notes"), F.flatten(in_order(drop)).alias("droppable_notes"))
    if hook_column:
        found = rows.withColumn("_at", F.struct("componentName", "filePath")).select("project_id", "_at", F.posexplode(hook_column).alias("pos", "h")).where("h.filePath is not null")
        first = found.groupBy("project_id", F.col("h.filePath").alias("path")).agg(F.min_by("h.name", F.struct("_at", "pos")).alias("name"), F.min(F.struct("_at", "pos")).alias("at"))
        none = empty(NAMED)
        part = F.struct(F.coalesce("name", F.lit("")).alias("name"), F.col("path").alias("file_path"), F.lit("Custom_Hook").alias("component_type"), F.col("_source").alias("source_code"), none.alias("props"), none.alias("hooks"), none.alias("state_variables"), empty("array<string>").alias("contexts_consumed")).cast(PART)
        second = _sources(first, corpus, "path", "_source").groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]).alias("secondary"))
        tops = tops.join(second, "project_id", "left")
    else:
        tops = tops.withColumn("secondary", empty(f"array<{PART}>"))
    out = tops.join(near_lists, "project_id", "left")
    if routes is not None and task_type == "feature_addition":
        table = routes.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("routerComponent", "routePath", "isNested", "isProtected", "isLazy", "routerFile", "targetComponent", "targetFile"))).alias("_routes"))
        out = out.join(table, "project_id", "left")
        found = F.coalesce("_routes", empty("array<struct<routerComponent:string,routePath:string,isNested:boolean,isProtected:boolean,isLazy:boolean,routerFile:string,targetComponent:string,targetFile:string>>"))
        asked = F.array(*map(F.lit, asked_routes or [])).cast("array<string>")
        out = out.withColumn("kept_notes", F.concat("kept_notes", routing_notes(found), absent_route_notes(asked, found)))
    assembly = F.struct("anchors", F.coalesce("secondary", empty(f"array<{PART}>")).alias("secondary"), F.coalesce("neighbours", empty(f"array<{NEIGHBOUR}>")).alias("neighbours"), "kept_notes", "droppable_notes").cast(ASSEMBLY)
    return truncated(out.select("project_id", assembly.alias("assembly")), task_type, budget)


def neighbour_uids(rows: DataFrame) -> DataFrame:
    """``project_id, uid`` of all neighbours in a template's rows."""
    lists = [c for c in ("directParents", "usedByComponents", "callers", "children") if c in rows.columns]
    uids = F.array_distinct(F.flatten(F.array(*[F.transform(c, lambda n: F.coalesce(n["uid"], F.concat(n["name"], F.lit("::"), n["filePath"]))) for c in lists])))
    return rows.select("project_id", F.explode(uids).alias("uid")).where("uid is not null").distinct()


def overview(rows: DataFrame, budget: int = BUDGET, spec_tokens: int = 0) -> DataFrame:
    """``project_id, entries, note``: the largest components, the smallest of them dropped until names, props, hooks and state fit."""
    joined = lambda c: token_estimate(F.array_join(c, " "))
    cost = token_estimate(F.concat_ws(" ", "componentName", "filePath")) + joined("propNames") + joined("hookNames") + joined("stateNames")
    entry = F.struct((-F.col("weight")).alias("order"), "componentName", "filePath", "componentType", "propNames", "hookNames", "stateNames", cost.alias("cost"))
    lists = rows.where("componentName is not null").groupBy("project_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    room = F.lit(budget - spec_tokens) - token_estimate(F.lit(OVERVIEW_NOTE))
    fits = F.aggregate("entries", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n")), lambda s, e: F.struct((s["sum"] + e["cost"]).alias("sum"), (s["n"] + F.when(s["sum"] + e["cost"] <= room, 1).otherwise(0)).alias("n")))
    return lists.select("project_id", F.slice("entries", 1, fits["n"]).alias("entries"), F.lit(OVERVIEW_NOTE).alias("note"))


def render(df: DataFrame, project: str = "project_id", task_type: str = "task_type", column: str = "assembly") -> DataFrame:
    """``df`` with ``context``, the assembly as headed text."""
    a = F.col(column)
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"**{label}:** "), value, F.lit("\n"))).otherwise(F.lit(""))
    body = lambda p: F.when(F.coalesce(p["source_code"], F.lit("")) != "", F.concat(F.lit("```"), F.when(p["file_path"].endswith(".tsx"), "tsx").otherwise("jsx"), F.lit("\n"), p["source_code"], F.lit("\n```\n"))).otherwise(F.lit(""))
    target = lambda p: F.concat(
        F.lit("\n#### "), p["name"], F.lit(" (`"), p["file_path"], F.lit("`)\n\n"), body(p), line("Props", names(p["props"], ", ")), line("Hooks used", names(p["hooks"], ", ")), line("State", names(p["state_variables"], ", ")), line("Consumes context", F.array_join(p["contexts_consumed"], ", "))
    )
    item = lambda label, value: F.when(value != "", F.concat(F.lit(f"\n- {label}: "), value)).otherwise(F.lit(""))
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    required = lambda n: names(F.filter(n["props"], lambda p: p["isRequired"]), ", ")
    near = lambda n: F.concat(
        F.lit("\n\n**"), n["name"], F.lit("** (`"), n["file_path"], F.lit("`)"), F.coalesce(F.concat(F.lit("\n- "), F.try_element_at(roles, n["role"])), F.lit("")), item("Props", names(n["props"], ", ")), item("Required", required(n)), item("State", names(n["state_variables"], ", "))
    )
    targets = F.array_join(F.transform(F.concat(a["anchors"], a["secondary"]), target), "")
    related = F.when(F.size(a["neighbours"]) > 0, F.concat(F.lit("\n---\n\n### Related Components"), F.array_join(F.transform(a["neighbours"], near), ""), F.lit("\n"))).otherwise(F.lit(""))
    notes = F.concat(a["kept_notes"], a["droppable_notes"])
    cross = F.when(F.size(notes) > 0, F.concat(F.lit("\n---\n\n### Cross-Cutting Notes\n"), F.array_join(F.transform(notes, lambda n: F.concat(F.lit("\n- "), n)), ""), F.lit("\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("## Project Context\n\nYou are working on the **"), F.col(project), F.lit("** React project.\n\n**Task type:** "), F.col(task_type), F.lit("\n\n---\n\n### Target Components\n"))
    return df.withColumn("context", F.concat(head, targets, related, cross))


def whole_files(tasks: DataFrame, corpus: DataFrame) -> DataFrame:
    """``task_id, path, source, missing`` of every file a task's reference touches; files it creates have no source by nature."""
    none = F.array().cast("array<string>")
    wanted = tasks.select("task_id", "project_id", F.explode(F.array_union(F.coalesce("files_modified", none), F.coalesce("files_created", none))).alias("path"))
    return wanted.join(corpus.select("project_id", "path", "source"), ["project_id", "path"], "left").withColumn("missing", F.col("source").isNull())


def floor(tasks: DataFrame) -> DataFrame:
    """The empty context of every task."""
    return tasks.select("task_id", F.lit("").alias("context"), F.lit(0).alias("tokens"))


def is_stop(query: Column) -> Column:
    """Whether a follow-up query says that nothing more is wanted."""
    return query.isNull() | F.upper(F.trim(query)).isin(*STOP_TOKENS)


def rounds(retrieve: Callable[[str], DataFrame], next_query: Callable[[DataFrame, int], str | None], spec: str, most: int = 1) -> tuple[DataFrame, list[str]]:
    """Retrieval in rounds: the last result counts, the queries are the history."""
    query, history, result = spec, [], None
    for turn in range(max(1, most)):
        result = retrieve(query)
        history.append(query)
        query = next_query(result, turn)
        if query is None or query.strip().upper() in STOP_TOKENS:
            break
    return result, history
