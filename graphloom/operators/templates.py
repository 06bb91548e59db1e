"""Graph retrieval templates. Every optional branch is aggregated by anchor before it is joined, so a template's work is linear in the edges
at its anchors instead of the product of its branches. Rows come in no order; ``ordered`` sorts them for a reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.operators.graph import Branch, Graph, collected, defining_files, in_project, neighbours, with_branches
from graphloom.schemas import ANCHORS, COMPONENTS


def prop(name: str, kind: str = "string") -> Column:
    return F.col("props")[name].cast(kind)


def _node(*names: str) -> dict[str, Column]:
    known = {"name": "name", "filePath": "file_path", "uid": "uid"}
    return {n: F.col(known[n]) if n in known else prop(n, "boolean" if n.startswith("is") else "string") for n in names}


def _defined() -> dict[str, Column]:
    return {"name": F.col("name"), "filePath": F.col("defined_in")}


def _anchors(graph: Graph, project_id: str | None, names: Sequence[str] | DataFrame, labels: Sequence[str]) -> DataFrame:
    found = in_project(graph, labels, project_id)
    if isinstance(names, DataFrame):  # project_id, name
        return found.join(names.select("project_id", "name").distinct(), ["project_id", "name"], "left_semi")
    return found.where(F.col("name").isin(*names)) if names else found.limit(0)


def _result(graph: Graph, anchors: DataFrame, branches: Sequence[Branch], more: Sequence[DataFrame] = (), files: bool = False) -> DataFrame:
    names = [*[b.name for b in branches], *[f.columns[-1] for f in more]]
    out = with_branches(graph, anchors.select("project_id", "node_id", "name", "file_path", "label"), branches, more, files)
    return out.select("project_id", F.col("name").alias("componentName"), F.col("file_path").alias("filePath"), F.col("label").alias("componentType"), *names)


def ordered(rows: DataFrame) -> DataFrame:
    """A template's rows by project, component and file."""
    return rows.orderBy("project_id", "componentName", "filePath")


#: The branches that several templates share.
def _shared(*names: str) -> list[Branch]:
    known = {
        "acceptedProps": lambda: Branch("acceptedProps", ("ACCEPTS_PROP",), _node("name", "type", "isRequired")),
        "libraryHooks": lambda: Branch("libraryHooks", ("USES_LIBRARY_HOOK",), _node("name", "source")),
        "customHooks": lambda: Branch("customHooks", ("USES_CUSTOM_HOOK",), _node("name", "filePath")),
        "stateVars": lambda: Branch("stateVars", ("DECLARES_STATE",), _node("name", "type", "defaultValue")),
        "classStateVars": lambda: Branch("classStateVars", ("DECLARES_CLASS_STATE",), _node("name", "type", "defaultValue")),
        "eventHandlers": lambda: Branch("eventHandlers", ("HAS_HANDLER",), {"eventType": prop("eventType"), "handlerName": F.col("name")}, key="handlerName"),
        "children": lambda: Branch("children", ("USES_COMPONENT",), _node("name", "filePath", "uid"), labels=COMPONENTS),
    }
    return [known[n]() for n in names]


def anchor_candidates(graph: Graph, project_id: str | None = None) -> DataFrame:
    """Every node that can be an anchor: ``name, uid, filePath, label``."""
    return in_project(graph, ANCHORS, project_id).select("project_id", "name", "uid", F.col("file_path").alias("filePath"), "label")


def bug_fix(graph: Graph, names, project_id: str | None = None) -> DataFrame:
    """Anchors (components or hooks) with their interface, parents that pass props, hooks they delegate to, and their users."""
    return _result(
        graph,
        _anchors(graph, project_id, names, ANCHORS),
        [
            *_shared("acceptedProps", "libraryHooks", "customHooks", "stateVars", "classStateVars", "eventHandlers"),
            Branch("directParents", ("PASSES_PROP",), _node("name", "filePath", "uid"), outgoing=False, labels=COMPONENTS),
            Branch("delegatedHooks", ("USES_CUSTOM_HOOK",), _defined(), labels=("Custom_Hook",)),
            Branch("usedByComponents", ("USES_CUSTOM_HOOK",), _node("name", "filePath", "uid"), outgoing=False, labels=ANCHORS),
        ],
        files=True,
    )


def feature_addition(graph: Graph, names, project_id: str | None = None) -> DataFrame:
    """Anchor components with children, interface, the contexts they consume with who provides them, and their children's contexts."""
    anchors = _anchors(graph, project_id, names, COMPONENTS)
    contexts = neighbours(graph, anchors, ["CONSUMES_CONTEXT"], labels=("Context",)).select("project_id", "anchor_id", F.col("node_id").alias("ctx_id"), F.col("name").alias("ctx_name"))
    provided = graph.edges.where("rel = 'PROVIDES_CONTEXT'").select("project_id", F.col("dst_id").alias("ctx_id"), F.col("src_id").alias("node_id"))
    makers = graph.nodes.where(F.col("label").isin(*COMPONENTS)).select("project_id", "node_id", F.col("name").alias("provider"))
    providers = provided.join(makers, ["project_id", "node_id"]).join(defining_files(graph), ["project_id", "node_id"], "left").drop("node_id")
    consumed = contexts.join(providers, ["project_id", "ctx_id"], "left")
    children = neighbours(graph, anchors, ["USES_COMPONENT"], labels=COMPONENTS).select("project_id", F.col("anchor_id").alias("top_id"), "node_id").distinct()
    below = graph.edges.where("rel = 'CONSUMES_CONTEXT'").select("project_id", F.col("src_id").alias("node_id"), F.col("dst_id").alias("ctx_id"))
    below = children.join(below, ["project_id", "node_id"]).select("project_id", F.col("top_id").alias("anchor_id"), F.col("ctx_id").alias("node_id")).distinct()
    below = below.join(graph.nodes.where("label = 'Context'").select("project_id", "node_id", "name"), ["project_id", "node_id"])
    return _result(
        graph,
        anchors,
        _shared("children", "acceptedProps", "libraryHooks", "customHooks", "stateVars"),
        [
            collected(consumed, "consumedContexts", {"name": F.col("ctx_name"), "providerName": F.col("provider"), "providerFile": F.col("defined_in")}, "name"),
            collected(below, "childConsumedContexts", {"name": F.col("name")}, "name"),
        ],
    )


def routing_table(graph: Graph, project_id: str | None = None) -> DataFrame:
    """Every route between components of a project."""
    routers = in_project(graph, COMPONENTS, project_id)
    hops = neighbours(graph, routers, ["ROUTES_TO"], labels=COMPONENTS)
    own = routers.select("project_id", F.col("node_id").alias("anchor_id"), F.col("name").alias("routerComponent"), F.col("file_path").alias("routerFile"))
    flag = lambda k: F.col("edge_props")[k].cast("boolean").alias(k)
    return (
        hops.join(own, ["project_id", "anchor_id"])
        .select("project_id", "routerComponent", "routerFile", F.col("edge_props")["path"].alias("routePath"), flag("isNested"), flag("isProtected"), flag("isLazy"), F.col("name").alias("targetComponent"), F.col("file_path").alias("targetFile"))
    )


def refactoring(graph: Graph, names, project_id: str | None = None) -> DataFrame:
    """Anchor components with all callers, their inner structure and children."""
    return _result(
        graph,
        _anchors(graph, project_id, names, COMPONENTS),
        [
            *_shared("acceptedProps"),
            Branch("callers", ("USES_COMPONENT",), {**_defined(), "uid": F.col("uid")}, outgoing=False, labels=COMPONENTS),
            *_shared("libraryHooks"),
            Branch("customHooks", ("USES_CUSTOM_HOOK",), _defined(), labels=("Custom_Hook",)),
            Branch("stateVars", ("DECLARES_STATE",), _node("name", "type", "defaultValue", "setterName")),
            *_shared("classStateVars", "eventHandlers", "children"),
        ],
        files=True,
    )


def caller_props(graph: Graph, names, project_id: str | None = None) -> DataFrame:
    """``componentName, callerUid, propsPassed`` (with repeats, in order): anchors of one name merge."""
    anchors = _anchors(graph, project_id, names, COMPONENTS)
    own = anchors.select("project_id", F.col("node_id").alias("anchor_id"), F.col("name").alias("componentName"))
    passed = neighbours(graph, anchors, ["PASSES_PROP"], outgoing=False, labels=COMPONENTS).join(own, ["project_id", "anchor_id"])
    return passed.groupBy("project_id", "componentName", F.col("uid").alias("callerUid")).agg(F.sort_array(F.collect_list(F.col("edge_props")["propName"])).alias("propsPassed"))


def neighbor_props(graph: Graph, uids: DataFrame, project_id: str | None = None) -> DataFrame:
    """``uid, props, stateVars`` of the components whose uid is asked for (``project_id, uid``)."""
    anchors = in_project(graph, COMPONENTS, project_id).join(uids.select("project_id", "uid").distinct(), ["project_id", "uid"], "left_semi")
    branches = [
        Branch("neighbour_props", ("ACCEPTS_PROP",), _node("name", "type", "isRequired")),
        Branch("stateVars", ("DECLARES_STATE", "DECLARES_CLASS_STATE"), _node("name", "type")),
    ]
    return with_branches(graph, anchors.select("project_id", "node_id", "uid"), branches).select("project_id", "uid", F.col("neighbour_props").alias("props"), "stateVars")


def project_overview(graph: Graph, limit: int = 40, project_id: str | None = None, projects: DataFrame | None = None) -> DataFrame:
    """The ``limit`` components of each project (one, those in ``projects.project_id``, or all) with the most props, hooks and state."""
    components = in_project(graph, COMPONENTS, project_id)
    if projects is not None:
        components = components.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    kinds = {"propNames": ("ACCEPTS_PROP",), "libraryHookNames": ("USES_LIBRARY_HOOK",), "customHookNames": ("USES_CUSTOM_HOOK",), "plainState": ("DECLARES_STATE",), "classState": ("DECLARES_CLASS_STATE",)}
    branches = [Branch(name, rels, {"name": F.col("name")}) for name, rels in kinds.items()]
    names = lambda c: F.transform(c, lambda x: x["name"])
    out = with_branches(graph, components.select("project_id", "node_id", "name", "file_path", "label"), branches).select(
        "project_id", F.col("name").alias("componentName"), F.col("file_path").alias("filePath"), F.col("label").alias("componentType"), names("propNames").alias("propNames"),
        F.concat(names("libraryHookNames"), names("customHookNames")).alias("hookNames"), F.concat(names("plainState"), names("classState")).alias("stateNames"),
    )
    out = out.withColumn("weight", F.size("propNames") + F.size("hookNames") + F.size("stateNames"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("weight"), "componentName", "filePath"))
    return out.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def resolve_project(nodes: DataFrame, name: str) -> DataFrame:
    """``project_id`` of the project with a name."""
    return nodes.where((F.col("label") == "Project") & (F.col("name") == name)).select("project_id").distinct()


def orphan_hooks(nodes: DataFrame) -> DataFrame:
    """Library hooks whose source no library of the project has."""
    libraries = nodes.where("label = 'Library'").select("project_id", F.col("name").alias("source"))
    hooks = nodes.where("label = 'Library_Hook'").select("project_id", "uid", "name", prop("source").alias("source"))
    return hooks.join(libraries, ["project_id", "source"], "left_anti")


def hook_edges(graph: Graph) -> DataFrame:
    """``owner, hook, source, count`` of every use of a library hook."""
    own = graph.nodes.select("project_id", F.col("node_id").alias("src_id"), F.col("uid").alias("owner"))
    hook = graph.nodes.where("label = 'Library_Hook'").select("project_id", F.col("node_id").alias("dst_id"), F.col("name").alias("hook"), prop("source").alias("source"))
    used = graph.edges.where("rel = 'USES_LIBRARY_HOOK'").withColumn("count", prop("count", "bigint"))
    return used.join(own, ["project_id", "src_id"]).join(hook, ["project_id", "dst_id"]).select("project_id", "owner", "hook", "source", "count")


DISPATCH = {"bug_fix": bug_fix, "feature_addition": feature_addition, "refactoring": refactoring}
