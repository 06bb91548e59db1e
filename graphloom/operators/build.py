"""Nodes and edges from extraction records, in one batch: what a sequence of keyed upserts would leave behind.

Every write carries its place (file, list position), so that the last writer wins as it does in file order; an edge whose end does not exist is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.text import is_hook_name, is_literal
from graphloom.functions.udf import arrow_udf
from graphloom.operators.graph import Graph, last_writer, set_root
from graphloom.operators.resolve import children, contexts, manifest_files
from graphloom.schemas import ANCHORS, COMPONENTS, EXTRACTION, NODE_FIELDS
from graphloom.sources.store import released, written

# Tags that wrap a root component, and where an entry file is looked for first.
WRAPPERS = (
    "StrictMode", "React.StrictMode", "Provider", "BrowserRouter", "HashRouter", "MemoryRouter", "Router", "QueryClientProvider", "ThemeProvider", "PersistGate", "Suspense", "ErrorBoundary",
)
ENTRIES = (
    "src/index.jsx", "src/index.js", "src/index.tsx", "src/index.ts", "src/main.jsx", "src/main.js", "src/main.tsx", "src/main.ts", "index.jsx", "index.js", "index.tsx", "index.ts",
)
RENDER = r"(?<![\w$])(?:render|hydrate)\("


def node_id(project: Column, label: Column, uid: Column) -> Column:
    """A key that needs no counter: equal nodes get equal ids wherever they are made."""
    return F.xxhash64(project, label, uid)


#: Properties that repeat a column of their node; ``graph_nodes`` puts them back when every node has been moved to its other writes.
REPEATED = ("uid", "name", "filePath")


def nodes_of(df: DataFrame, label: str, uid: Column, name: Column, file_path: Column, props: dict[str, Column], pos: Column | None = None) -> DataFrame:
    """Node rows of a label with the place of their write, as far as they need it: a uid that several entries write names their file. Properties that are null are
    absent, those in ``REPEATED`` left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in props.items() if k not in REPEATED])
    at = F.lit(0) if pos is None else pos
    return df.select(
        "project_id", F.lit(label).alias("label"), uid.alias("uid"), name.alias("name"), file_path.alias("file_path"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("props"), at.cast("bigint").alias("_at"),
    )


def pairs_of(df: DataFrame, src: Column, dst: Column, props: dict[str, Column] | None = None, order: Sequence[Column] = (), keep: Sequence[str] = ()) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (props or {}).items()]).cast("array<struct<key:string,value:string>>")
    at = F.struct((order[0].cast("string") if order else F.lit("")).alias("file"), (order[1].cast("bigint") if len(order) > 1 else F.lit(0).cast("bigint")).alias("pos"))
    return df.select("project_id", src.alias("src_uid"), dst.alias("dst_uid"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("props"), at.alias("_at"), *keep)


#: Records with their lists, or by list a table of entries (``project_id, file_path, pos, x``, ``pos`` in the order of the list; one that is absent is empty) where a list may be too long for a row.
Extractions = DataFrame | Mapping[str, DataFrame]


def exploded(extractions: Extractions, column: str) -> DataFrame:
    """``project_id, file_path, pos, x`` for each entry of a list; entries without a name go where they have one."""
    if isinstance(extractions, Mapping):
        if column in extractions:
            return extractions[column]
        spark = next(iter(extractions.values())).sparkSession
        return spark.createDataFrame([], f"project_id string, file_path string, pos bigint, x {EXTRACTION[column][len('array<') : -1]}")
    return extractions.select("project_id", "file_path", F.posexplode(column).alias("pos", "x"))


def uid(*parts: Column) -> Column:
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit("::"), p]
    return F.concat(*out)


def _named(df: DataFrame, *fields: str) -> DataFrame:
    for f in fields:
        df = df.where(F.coalesce(F.col(f"x.{f}"), F.lit("")) != "")
    return df


def X(field: str) -> Column:  # noqa: N802
    """A field of an exploded entry."""
    return F.col(f"x.{field}")


def or_else(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def _free_names(names: list[str] | None, inline: list[bool] | None) -> list[str] | None:
    """Of inline handlers with one name, the n-th gets the suffix ``_n`` unless that name is taken."""
    if names is None or inline is None:
        return None
    taken: set[str] = set()
    out = []
    for name, probe in zip(names, inline, strict=True):
        stored, n = name, 2
        while probe and stored in taken:
            stored, n = f"{name}_{n}", n + 1
        taken.add(stored)
        out.append(stored)
    return out


free_names = arrow_udf(_free_names, "array<string>")


def handlers(extractions: Extractions) -> DataFrame:
    """Event handlers with the name under which they are stored.

    Probing for a free name depends on all handlers before it, so a component's handlers (they are few) are one list; only lists in which a name
    repeats go through Python."""
    listed = _named(exploded(extractions, "eventHandlers"), "name", "componentName")
    entry = F.struct("pos", X("name").alias("name"), X("eventType").alias("eventType"), F.coalesce(X("isInline"), F.lit(False)).alias("probe"), X("isInline").alias("isInline"))
    of = listed.groupBy("project_id", "file_path", X("componentName").alias("componentName")).agg(F.sort_array(F.collect_list(entry)).alias("h"))
    names, probes = F.transform("h", lambda h: h["name"]), F.transform("h", lambda h: h["probe"])
    repeats = F.size(F.array_distinct(names)) < F.size(names)
    of = of.withColumn("stored", free_names(F.when(repeats, names), F.when(repeats, probes)))
    each = of.select("project_id", "file_path", "componentName", F.explode(F.arrays_zip("h", F.coalesce("stored", names).alias("stored"))).alias("z"))
    return each.select("project_id", "file_path", F.col("z.h.pos").alias("pos"), F.col("z.stored").alias("name"), F.col("z.h.eventType").alias("eventType"), "componentName", F.col("z.h.isInline").alias("isInline"))


def hook_calls(extractions: Extractions, projects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Hooks by component: ``category`` of the first call site, corrected to custom where a library's source is a file of the project, and
    the number of call sites.

    A source is looked up once a file, however many call sites name it. Components are dealt out whole, so that no task sorts all the calls that it has read."""
    components = _named(exploded(extractions, "components"), "name").where(~is_hook_name(X("name"))).select("project_id", "file_path", X("name").alias("component"), X("hookDetails").alias("hooks"))
    named = components.select("project_id", "file_path", F.explode("hooks").alias("h")).where("h.category = 'library' and h.source != '' and h.source != 'local'")
    asked = named.select("project_id", F.col("h.source").alias("specifier"), F.col("file_path").alias("current_file")).distinct()
    asked = asked.select(F.struct("*").alias("request_id"), "*", F.lit(None).cast("string").alias("symbol"))
    hit = F.col("request_id")
    local = written(manifest_files(asked, projects, manifest).select(hit["project_id"].alias("_project"), hit["current_file"].alias("_file"), hit["specifier"].alias("_source"), F.lit(True).alias("_local")))
    calls = components.repartition("project_id", "file_path", "component").select("project_id", "file_path", "component", F.posexplode("hooks").alias("call", "h"))
    tallied = calls.groupBy("project_id", "file_path", "component", F.col("h.name").alias("hook"), or_else(F.col("h.source"), "").alias("source")).agg(
        F.count("*").alias("count"), F.min_by("h.category", "call").alias("category"), F.min("call").alias("call")
    )
    tallied = tallied.withColumn("request_id", F.xxhash64("project_id", "file_path", "component", "hook", "source"))
    same = (F.col("project_id") == F.col("_project")) & F.col("file_path").eqNullSafe(F.col("_file")) & (F.col("source") == F.col("_source")) & (F.col("category") == "library")
    return tallied.join(local, same, "left").withColumn("category", F.when(F.col("_local"), "custom").otherwise(F.col("category"))).drop("_project", "_file", "_source", "_local")


def rendered_root(source: Column) -> Column:
    """The component that a file renders into the page: the tag after the call, else the last tag near it that is no wrapper."""
    direct = F.nullif(F.regexp_extract(source, RENDER + r"\s*<(\w+)[\s/>]", 1), F.lit(""))
    fits = lambda t: ~t.isin(*WRAPPERS) & ~t.startswith("React")
    call = F.regexp_instr(source, F.lit(RENDER))
    block = F.substring(source, F.greatest(call, F.lit(1)), F.lit(2000))
    tags = F.filter(F.regexp_extract_all(block, F.lit(r"<([A-Z]\w*)"), F.lit(1)), fits)
    return F.when(direct.isNotNull() & fits(direct), direct).when((call > 0) & (F.size(tags) > 0), F.element_at(tags, -1))


def roots(corpus: DataFrame, projects: DataFrame) -> DataFrame:
    """``project_id, file_path, name``: the first entry file that renders a component. The package's own entry comes first, then the usual
    names, then files that import react-dom by stem, depth and path. Corpus: ``project_id, path, source``."""
    usual = F.array_position(F.array(*map(F.lit, ENTRIES)), F.col("path"))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    known = corpus.join(projects.select("project_id", F.col("main")), "project_id", "left")
    place = F.when(F.col("path") == F.col("main"), 0).when(usual > 0, usual).otherwise(1000)
    ranked = known.withColumn("_place", place).where((F.col("_place") < 1000) | F.col("source").contains("react-dom")).withColumn("name", rendered_root(F.col("source"))).where("name is not null")
    order = F.struct("_place", ~stem.isin("index", "main"), F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))), "path")
    return ranked.groupBy("project_id").agg(F.min_by(F.struct(F.col("path").alias("file_path"), "name"), order).alias("r")).select("project_id", "r.*")


def _inner_hooks(extractions: Extractions) -> DataFrame:
    """Library hooks inside custom hooks."""
    inner = exploded(extractions, "customHookUsages")
    return inner.select("project_id", "file_path", "pos", X("hookName").alias("owner"), F.explode("x.libraryHooks").alias("h")).select("project_id", "file_path", "pos", "owner", "h.*")


def graph_nodes(projects: DataFrame, files: DataFrame, libraries: DataFrame, extractions: Extractions) -> DataFrame:
    """The nodes of all projects, before any is marked as the root; arguments as in ``build_graph``."""
    FILE, POS = F.col("file_path"), F.col("pos")  # noqa: N806
    manifest = files.select("project_id", "file_path")
    comps = _named(exploded(extractions, "components"), "name")
    calls = hook_calls(extractions, projects, manifest)
    used = calls.where("category = 'library'")
    inner_hooks = _inner_hooks(extractions)
    handled = handlers(extractions)
    states = _named(exploded(extractions, "stateVariables"), "name", "componentName")
    class_states = _named(exploded(extractions, "classStateVariables"), "name", "componentName")
    classes = _named(exploded(extractions, "classComponents"), "name")
    props = _named(exploded(extractions, "props"), "name", "componentName")
    ctx = _named(exploded(extractions, "contexts"), "name")
    own = uid(X("name"), FILE)
    part = uid(X("name"), X("componentName"), FILE)

    def hook_nodes(df: DataFrame, later: int) -> DataFrame:
        return nodes_of(df.where(is_hook_name(X("name"))), "Custom_Hook", own, X("name"), FILE, {"uid": own, "name": X("name"), "filePath": FILE, "exportType": or_else(X("exportType"), "none")}, F.col("pos") + later)

    def state_nodes(df: DataFrame, setter: str | None) -> DataFrame:
        return nodes_of(df, "State_Variable", part, X("name"), FILE, {
            "uid": part, "name": X("name"), "setterName": X("setterName") if setter is None else or_else(X("setterName"), setter), "type": or_else(X("type"), "unknown"),
            "defaultValue": or_else(X("defaultValue"), "undefined"), "filePath": FILE, "componentName": X("componentName"),
        }, POS)

    hook_uid = uid(F.col("hook"), F.col("source"))
    parts = [
        nodes_of(projects, "Project", F.col("project_id"), F.col("name"), F.lit(None).cast("string"), {"projectId": F.col("project_id"), "name": F.col("name"), "description": F.col("description"), "file_path": F.col("file_path")}),
        nodes_of(files, "File", FILE, F.col("name"), FILE, {"filePath": FILE, "name": F.col("name"), "modifiedAt": F.col("modifiedAt")}),
        nodes_of(libraries, "Library", F.col("name"), F.col("name"), F.lit(None).cast("string"), {"name": F.col("name"), "version": F.col("version"), "category": F.col("category")}),
        nodes_of(comps.where(~is_hook_name(X("name"))), "Function_Component", own, X("name"), FILE, {
            "uid": own, "name": X("name"), "filePath": FILE, "syntax": or_else(X("syntax"), "function"), "usesHooks": or_else(X("usesHooks"), False), "returnsJSX": or_else(X("returnsJSX"), True), "exportType": or_else(X("exportType"), "none"), "isRoot": F.lit(False),
        }, POS),
        hook_nodes(comps, 0),
        hook_nodes(_named(exploded(extractions, "customHooks"), "name"), 1 << 62),  # the list of hooks is written after that of components
        nodes_of(classes, "Class_Component", own, X("name"), FILE, {
            "uid": own, "name": X("name"), "filePath": FILE, "extendsClass": or_else(X("extendsClass"), "React.Component"), "returnsJSX": or_else(X("returnsJSX"), True), "exportType": or_else(X("exportType"), "none"),
            "hasConstructor": or_else(X("hasConstructor"), False), "lifecycleMethods": F.to_json(F.coalesce(X("lifecycleMethods"), F.array().cast("array<string>"))), "isRoot": F.lit(False),
        }, POS),
        nodes_of(used, "Library_Hook", hook_uid, F.col("hook"), F.lit(None).cast("string"), {"uid": hook_uid, "name": F.col("hook"), "source": F.col("source")}),
        nodes_of(inner_hooks, "Library_Hook", uid(F.col("name"), F.col("source")), F.col("name"), F.lit(None).cast("string"), {"uid": uid(F.col("name"), F.col("source")), "name": F.col("name"), "source": F.col("source")}),
        nodes_of(props, "Prop", part, X("name"), FILE, {"uid": part, "name": X("name"), "componentName": X("componentName"), "filePath": FILE, "type": or_else(X("type"), "unknown"), "isRequired": X("isRequired")}, POS),
        state_nodes(states, None), state_nodes(class_states, "this.setState"),
        nodes_of(ctx, "Context", own, X("name"), FILE, {"uid": own, "name": X("name"), "filePath": FILE, "defaultValue": or_else(X("defaultValue"), "undefined"), "exportType": or_else(X("exportType"), "none")}, POS),
        nodes_of(handled, "EventHandler", uid(F.col("name"), F.col("componentName"), FILE), F.col("name"), FILE, {
            "uid": uid(F.col("name"), F.col("componentName"), FILE), "name": F.col("name"), "eventType": F.col("eventType"), "filePath": FILE, "componentName": F.col("componentName"), "isInline": or_else(F.col("isInline"), False),
        }, POS),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    last = last_writer(every, ["uid", "label", "project_id"], ["_at"])
    again = []
    for k, column in zip(REPEATED, ("uid", "name", "file_path"), strict=True):
        labels = [label for label, fields in NODE_FIELDS.items() if k in fields]
        again.append(F.when(F.col("label").isin(*labels) & F.col(column).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(column).alias("value"))))
    whole = F.map_concat(F.map_from_entries(F.array_compact(F.array(*again))), "props")
    return last.select("project_id", node_id(F.col("project_id"), F.col("label"), F.col("uid")).alias("node_id"), "label", "uid", "name", "file_path", whole.alias("props"))


def graph_edges(nodes: DataFrame, projects: DataFrame, files: DataFrame, libraries: DataFrame, extractions: Extractions, rendered: DataFrame | None = None, rels: Sequence[str] | None = None) -> DataFrame:
    """``project_id, rel, src_label, src_uid, dst_label, dst_uid, props`` of the edges between ``nodes`` (read several times), with ``rendered`` as ``roots`` gives it.

    Every edge is dealt out once, by its source: there the last write wins and the source is looked up. What a target is, is settled before, among few rows or by
    the row that writes both."""
    FILE, PLACE = F.col("file_path"), (F.col("file_path"), F.col("pos"))  # noqa: N806
    manifest = files.select("project_id", "file_path")
    kept = written if rels is None else (lambda df: df)  # what several kinds of edges read
    calls = kept(hook_calls(extractions, projects, manifest))
    used = calls.where("category = 'library'")
    inner = exploded(extractions, "customHookUsages")
    inner_hooks = _inner_hooks(extractions)
    handled = handlers(extractions)
    states = _named(exploded(extractions, "stateVariables"), "name", "componentName")
    class_states = _named(exploded(extractions, "classStateVariables"), "name", "componentName")
    props = _named(exploded(extractions, "props"), "name", "componentName")
    part = uid(X("name"), X("componentName"), FILE)
    hook_uid = uid(F.col("hook"), F.col("source"))

    sources: list[Sequence[str]] = []

    def ends(labels: Sequence[str]) -> DataFrame:
        return nodes.where(F.col("label").isin(*labels)).select("project_id", F.col("uid").alias("dst_uid"), F.col("label").alias("dst_label"))

    def edges(rel: str, pairs: DataFrame, src: Sequence[str], dst: Sequence[str] = (), key: Sequence[str] = (), made: str | None = None) -> DataFrame:
        """Pairs of one kind: between which labels, and by which properties two edges between the same ends are told apart. A target of the label ``made`` is
        written by the rows of the pairs themselves; without ``dst`` and ``made`` pairs have their ``dst_label``."""
        sources.append(src)
        if made:
            pairs = pairs.where("dst_uid is not null").withColumn("dst_label", F.lit(made))
        elif dst:
            pairs = pairs.join(ends(dst), ["project_id", "dst_uid"])
        own = F.concat_ws("\x00", *[F.coalesce(F.col("props")[k], F.lit("")) for k in key]) if key else F.lit("")
        own = F.col("_key") if "_key" in pairs.columns else own
        chosen = pairs if rels is None else pairs.where(F.col("rel").isin(*rels)) if "rel" in pairs.columns else pairs.where(F.lit(rel in rels))
        name = F.col("rel") if "rel" in pairs.columns else F.lit(rel)
        return chosen.select("project_id", "src_uid", "dst_uid", "dst_label", "props", "_at", own.alias("_key"), name.alias("rel"), F.lit(len(sources) - 1).alias("_call"))

    def joined(pairs: DataFrame) -> DataFrame:
        """All kinds at once: one edge for two ends (and the identifying properties), with the last write's properties; the source must exist."""
        last = last_writer(pairs.repartition("src_uid", "project_id"), ["src_uid", "project_id", "rel", "_call", "dst_label", "dst_uid", "_key"], ["_at"])
        allowed = F.element_at(F.array(*[F.array(*map(F.lit, src)) for src in sources]), F.col("_call") + 1)
        own = nodes.where(F.col("label").isin(*{x for src in sources for x in src})).select(F.col("uid").alias("src_uid"), "project_id", F.col("label").alias("src_label"))
        return last.join(own, ["src_uid", "project_id"]).where(F.array_contains(allowed, F.col("src_label"))).select("project_id", "rel", "src_label", "src_uid", "dst_label", "dst_uid", "props")

    def meant(df: DataFrame, name: str, source: str, found: DataFrame, labels: Sequence[str]) -> DataFrame:
        """``df`` with the end that an import names."""
        key = ["project_id", "name", "specifier", "current_file"]
        hit = found.select(*key, F.col("uid").alias("dst_uid")).join(ends(labels), ["project_id", "dst_uid"])
        return df.withColumns({"name": X(name), "specifier": or_else(X(source), ""), "current_file": FILE}).join(hit, key)

    # Ends that imports name go through the resolution ladders.
    usages, routes = exploded(extractions, "componentUsages"), exploded(extractions, "routeDefinitions")
    givers, takers = exploded(extractions, "contextProviders"), exploded(extractions, "contextConsumers")
    ask = lambda df, name, source: df.select("project_id", X(name).alias("name"), or_else(X(source), "").alias("specifier"), FILE.alias("current_file"))
    hit = kept(children(ask(usages, "childComponent", "importSource").unionByName(ask(routes, "targetComponent", "importSource")), projects, nodes, manifest))
    usages, routes = meant(usages, "childComponent", "importSource", hit, COMPONENTS), meant(routes, "targetComponent", "importSource", hit, COMPONENTS)
    ctx_hit = kept(contexts(ask(givers, "contextName", "contextSource").unionByName(ask(takers, "contextName", "contextSource")), projects, nodes))
    givers, takers = meant(givers, "contextName", "contextSource", ctx_hit, ["Context"]), meant(takers, "contextName", "contextSource", ctx_hit, ["Context"])
    one = lambda rel, key, name, value: F.struct(F.lit(rel).alias("rel"), F.coalesce(key, F.lit("")).alias("_key"), F.lit(name).alias("k"), value.cast("string").alias("v"))
    each = F.concat(F.array(one("USES_COMPONENT", F.lit(""), "usage", or_else(X("usage"), "element"))), F.coalesce(F.transform(X("propsPassed"), lambda p: one("PASSES_PROP", p["propName"], "propName", p["propName"])), F.array()))
    told = usages.select("project_id", "file_path", "pos", uid(X("parentComponent"), FILE).alias("src_uid"), "dst_uid", "dst_label", F.explode(each).alias("e")).select("*", "e.*")
    kind = or_else(X("consumerType"), "function_component")
    taker = {"Class_Component": kind == "class_component", "Custom_Hook": kind == "custom_hook", "Function_Component": ~kind.isin("class_component", "custom_hook")}

    custom = calls.where("category = 'custom'").select("request_id", "project_id", F.col("source").alias("specifier"), F.col("file_path").alias("current_file"), F.col("hook").alias("symbol"), uid(F.col("component"), FILE).alias("src"))
    inner_custom = inner.select("project_id", "file_path", "pos", X("hookName").alias("owner"), F.posexplode("x.customHooks").alias("at", "h"))
    inner_custom = inner_custom.select(F.xxhash64("project_id", "file_path", F.lit("inner"), "pos", "at").alias("request_id"), "project_id", F.col("h.source").alias("specifier"), FILE.alias("current_file"), F.col("h.name").alias("symbol"), uid(F.col("owner"), FILE).alias("src"))

    def hook_pairs(df: DataFrame, here: str) -> DataFrame:
        """The file of a hook: this one, the one its import means, or the raw source, which no node has."""
        target = manifest_files(df.where(F.col("specifier") != here), projects, manifest).select("request_id", F.col("file_path").alias("_file"))
        found = df.join(target, "request_id", "left")
        file = F.when(F.col("specifier") == here, F.col("current_file")).otherwise(F.coalesce("_file", "specifier"))
        return pairs_of(found, F.col("src"), uid(F.col("symbol"), file))

    owner, comp_of = uid(X("componentName"), FILE), uid(F.col("componentName"), FILE)
    literal = {"init_is_literal": is_literal(or_else(X("defaultValue"), "undefined"))}
    flags = {"path": X("path"), **{k: or_else(X(k), False) for k in ("isNested", "isLazy", "isProtected")}}
    hooks = nodes.where("label = 'Library_Hook'").select("project_id", F.col("uid").alias("_hook"), F.col("props")["source"].alias("_source"))
    named = nodes.where("label = 'Library'").select("project_id", F.col("uid").alias("_library"))
    known = lambda df, src, given=None, keep=("dst_label",): pairs_of(df, src, F.col("dst_uid"), given, PLACE, keep)
    all_edges = [
        edges("BELONGS_TO", pairs_of(files, FILE, F.col("project_id")), ["File"], ["Project"]),
        edges("DEPENDS_ON", pairs_of(libraries, F.col("project_id"), F.col("name"), {"dependencyType": F.col("dependencyType")}), ["Project"], made="Library"),
        edges("DEFINED_IN", pairs_of(nodes.where(F.col("label").isin(*ANCHORS)), F.col("uid"), FILE), ANCHORS, ["File"]),
        edges("USES_LIBRARY_HOOK", pairs_of(used, uid(F.col("component"), FILE), hook_uid, {"count": F.col("count")}), ["Function_Component"], made="Library_Hook"),
        edges("USES_LIBRARY_HOOK", pairs_of(inner_hooks, uid(F.col("owner"), FILE), uid(F.col("name"), F.col("source")), {"count": or_else(F.col("count"), 1)}, PLACE), ["Custom_Hook"], made="Library_Hook"),
        edges("USES_CUSTOM_HOOK", hook_pairs(custom, "local"), ["Function_Component"], ["Custom_Hook"]),
        edges("USES_CUSTOM_HOOK", hook_pairs(inner_custom, "same_file"), ["Custom_Hook"], ["Custom_Hook"]),
        edges("ACCEPTS_PROP", pairs_of(props, owner, part), COMPONENTS, made="Prop"),
        edges("HAS_HANDLER", pairs_of(handled, comp_of, uid(F.col("name"), F.col("componentName"), FILE)), COMPONENTS, made="EventHandler"),
        edges("DECLARES_STATE", pairs_of(states.where(~is_hook_name(X("componentName"))), owner, part, literal, PLACE), ["Function_Component"], made="State_Variable"),
        edges("DECLARES_STATE", pairs_of(states.where(is_hook_name(X("componentName"))), owner, part, literal, PLACE), ["Custom_Hook"], made="State_Variable"),
        edges("DECLARES_CLASS_STATE", pairs_of(class_states, owner, part, {"declarationStyle": or_else(X("declarationStyle"), "constructor")}, PLACE), ["Class_Component"], made="State_Variable"),
        edges("", known(told, F.col("src_uid"), {"usage": F.when(F.col("k") == "usage", F.col("v")), "propName": F.when(F.col("k") == "propName", F.col("v"))}, ["dst_label", "rel", "_key"]), COMPONENTS),
        edges("PROVIDES_CONTEXT", known(givers, uid(X("componentName"), FILE), {"valueExpression": or_else(X("valueExpression"), "")}), COMPONENTS),
        *[edges("CONSUMES_CONTEXT", known(takers.where(is_kind), uid(X("consumerName"), FILE)), [label]) for label, is_kind in taker.items()],
        edges("ROUTES_TO", known(routes, uid(X("routingComponent"), FILE), flags), COMPONENTS),
        edges("PROVIDED_BY", pairs_of(hooks.join(named, (hooks["project_id"] == named["project_id"]) & (hooks["_source"] == named["_library"])).drop(named["project_id"]), F.col("_hook"), F.col("_library")), ["Library_Hook"], made="Library"),
    ]
    if rendered is not None:
        tops = nodes.where(F.col("label").isin(*COMPONENTS)).select("project_id", "name", F.col("uid").alias("dst_uid"), F.col("label").alias("dst_label"))
        all_edges.append(edges("RENDERS_ROOT_COMPONENT", pairs_of(rendered.join(tops, ["project_id", "name"]), FILE, F.col("dst_uid"), keep=["dst_label"]), ["File"]))
    out = all_edges[0]
    for e in all_edges[1:]:
        out = out.unionByName(e)
    return joined(out)


def with_ids(edges: DataFrame) -> DataFrame:
    """Edges by uid as ``schemas.EDGES``."""
    end = lambda side: node_id(F.col("project_id"), F.col(f"{side}_label"), F.col(f"{side}_uid")).alias(f"{side}_id")
    return edges.select("project_id", end("src"), end("dst"), "rel", "props")


def build_graph(projects: DataFrame, files: DataFrame, libraries: DataFrame, extractions: Extractions, corpus: DataFrame | None = None, rels: Sequence[str] | None = None) -> Graph:
    """The graph of all projects.

    Projects: ``project_id, name, description, file_path, main, aliases, base_url``; files: ``project_id, file_path, name, modifiedAt``; libraries: ``project_id,
    name, version, category, dependencyType``; extractions: ``schemas.EXTRACTIONS``, or a table of entries for each of their lists. With ``rels`` only edges of these kinds are made."""
    # Written, as every ladder and every end of an edge looks nodes up.
    nodes = released(graph_nodes(projects, files, libraries, extractions))
    rendered = None if corpus is None else written(roots(corpus, projects))
    edges = with_ids(graph_edges(nodes, projects, files, libraries, extractions, rendered, rels))
    return Graph(nodes if rendered is None else set_root(nodes, rendered), edges)


#: Lists of what other files can refer to.
CONTENT = ("components", "customHooks", "classComponents", "contexts")


def has_content(extractions: DataFrame) -> Column:
    """Whether a file holds anything that other files can refer to."""
    return F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in CONTENT]) > 0


def content(extractions: Extractions, files: DataFrame) -> DataFrame:
    """``files`` (``project_id, file_path``) with ``has_content`` and the number of entries in each list of ``CONTENT``. Entries are counted, never gathered."""
    own = exploded(extractions, CONTENT[0]).select("project_id", "file_path", F.lit(CONTENT[0]).alias("list"))
    for name in CONTENT[1:]:
        own = own.unionByName(exploded(extractions, name).select("project_id", "file_path", F.lit(name).alias("list")))
    counts = own.groupBy("project_id", "file_path").agg(*[F.count_if(F.col("list") == name).alias(name) for name in CONTENT])
    found = files.join(counts, ["project_id", "file_path"], "left").fillna(0, list(CONTENT))
    return found.withColumn("has_content", F.greatest(*CONTENT) > 0)
