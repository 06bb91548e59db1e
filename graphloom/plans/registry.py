"""Registered queries over the fixture tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.functions import paths, text
from graphloom.operators import cost, edits, evaluation, graph, lexical, progress, rank, resolve, templates
from graphloom.plans import binding
from graphloom.plans.binding import CALLS_SQL, GRAPH_SQL, PRICES_SQL, RESULTS_SQL, table
from graphloom.sources import dump, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "tmpl_anchor_context"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def flat(column: str, *fields: str) -> Column:
    """An array of structs as one string: fields by ``|``, entries in order by ``;``."""
    entry = lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields]) if fields else x
    return F.array_join(F.array_sort(F.transform(column, entry)), ";").alias(column)


def agg(expr: str, source: str) -> str:
    """The string that ``flat`` gives, for each component ``x`` of a query."""
    return f"coalesce((SELECT string_agg(DISTINCT {expr}, ';' ORDER BY {expr}) FROM {source}), '')"


# Graph

NODE_COUNTS = """SELECT 'Project' AS label, count(DISTINCT project_id) AS n FROM place UNION ALL SELECT 'File', count(*) FROM place UNION ALL SELECT label, count(*) FROM comp GROUP BY label
  UNION ALL SELECT 'Custom_Hook', count(*) FROM hooks UNION ALL SELECT 'Context', count(DISTINCT project_id) FROM place
  UNION ALL SELECT 'Prop', count(*) FROM prio UNION ALL SELECT 'EventHandler', count(*) FROM status UNION ALL SELECT 'State_Variable', (SELECT count(*) FROM years) + (SELECT count(*) FROM supp)
  UNION ALL SELECT 'Library_Hook', count(DISTINCT (project_id, export)) FROM cust"""
EDGE_COUNTS = """SELECT 'BELONGS_TO' AS rel, count(*) AS n FROM place UNION ALL SELECT 'DEFINED_IN', count(*) FROM anchors UNION ALL SELECT 'ACCEPTS_PROP', count(*) FROM prio
  UNION ALL SELECT 'HAS_HANDLER', count(*) FROM status UNION ALL SELECT 'DECLARES_STATE', count(*) FROM years UNION ALL SELECT 'DECLARES_CLASS_STATE', count(*) FROM supp
  UNION ALL SELECT 'USES_LIBRARY_HOOK', count(*) FROM cust UNION ALL SELECT 'USES_CUSTOM_HOOK', count(*) FROM hooked UNION ALL SELECT 'PROVIDES_CONTEXT', count(*) FROM firsts
  UNION ALL SELECT 'CONSUMES_CONTEXT', count(*) FROM consumers
  UNION ALL SELECT 'USES_COMPONENT', count(*) FROM uses UNION ALL SELECT 'PASSES_PROP', count(*) FROM deals UNION ALL SELECT 'ROUTES_TO', count(*) FROM routed"""


@query(f"WITH {GRAPH_SQL} SELECT label, CAST(n AS BIGINT) AS n FROM ({NODE_COUNTS})")
def graph_label_counts(spark, sf):
    return graph.label_counts(binding.graph(spark, sf, rels=["BELONGS_TO"]).nodes).orderBy(F.desc("n"), "label")


@query(f"WITH {GRAPH_SQL} SELECT rel, CAST(n AS BIGINT) AS n FROM ({EDGE_COUNTS})")
def graph_edge_type_counts(spark, sf):
    return graph.edge_type_counts(binding.graph(spark, sf, labels=["File"]).edges).orderBy(F.desc("n"), "rel")


@query(f"""WITH {GRAPH_SQL} SELECT project_id, name, uid, file_path AS "filePath", label FROM anchors""")
def graph_anchor_candidates(spark, sf):
    g = binding.graph(spark, sf, ["Function_Component", "Class_Component", "Custom_Hook"], ["DEFINED_IN", "BELONGS_TO"])
    return templates.anchor_candidates(g).orderBy("project_id", "name", "uid")


PROPS = agg("v || '|order|' || CASE WHEN v LIKE '1%' THEN 'true' ELSE 'false' END", "prio p WHERE p.id = x.id AND x.k = 'c'")
HOOKS = "CASE WHEN x.k = 'c' THEN x.export || '|segment' ELSE '' END"
USED = "((x.k = 'c' AND x.id % 3 = 0) OR (x.k = 's' AND x.id % 2 = 0))"
CUSTOM = f"CASE WHEN {USED} THEN 'use' || x.file_path || '|' || x.file_path ELSE '' END"
STATES = agg("v || '|int|-'", "years y WHERE y.id = x.id AND x.k = 'c'")
SET_STATES = agg("v || '|int|-|-'", "years y WHERE y.id = x.id AND x.k = 'c'")
CLASS_STATES = "CASE WHEN x.k = 's' THEN 's' || (x.id % 3) || '|flag|0' ELSE '' END"
HANDLERS = agg("v || '|on' || v", "status s WHERE s.id = x.id AND x.k = 'c'")
PARENTS = agg("s.name || '|' || s.file_path || '|' || s.uid", "deals d JOIN supp s ON s.id = d.supp WHERE d.cust = x.id AND x.k = 'c'")
CHILDREN = agg("s.name || '|' || s.file_path || '|' || s.uid", "uses d JOIN supp s ON s.id = d.supp WHERE d.cust = x.id AND x.k = 'c'")
CALLERS = agg("c.name || '|' || c.file_path || '|' || c.uid", "uses d JOIN cust c ON c.id = d.cust WHERE d.supp = x.id AND x.k = 's'")
USERS = agg("h.name || '|' || h.file_path || '|' || h.uid", "hooked h WHERE h.file_path = x.file_path AND x.k = 'h'")
CONSUMED = agg("'Ctx' || p.project_id || '|' || p.name || '|' || p.file_path", "providers p JOIN consumers u ON u.project_id = p.project_id WHERE u.id = x.id AND u.k = x.k")
BELOW = agg("'Ctx' || u.project_id", "uses d JOIN consumers u ON u.id = d.supp AND u.k = 's' WHERE d.cust = x.id AND x.k = 'c'")
BASE = 'project_id, name AS "componentName", file_path AS "filePath", label AS "componentType"'
TOP = ("project_id", "componentName", "filePath", "componentType")
#: What the templates read: labels of anchors and neighbours, and the relationships at anchors.
COMPONENT_LABELS = ["File", "Function_Component", "Class_Component"]
INTERFACE_LABELS = [*COMPONENT_LABELS, "Custom_Hook", "Prop", "EventHandler", "State_Variable", "Library_Hook"]
PLACE_RELS = ["BELONGS_TO", "DEFINED_IN"]
INTERFACE_RELS = [*PLACE_RELS, "ACCEPTS_PROP", "HAS_HANDLER", "DECLARES_STATE", "DECLARES_CLASS_STATE", "USES_LIBRARY_HOOK", "USES_CUSTOM_HOOK"]


def components_only(g: graph.Graph) -> DataFrame:
    return g.nodes.where(F.col("label").isin("Function_Component", "Class_Component"))


@query(f"""WITH {GRAPH_SQL} SELECT {BASE}, {PROPS} AS "acceptedProps", {HOOKS} AS "libraryHooks", {CUSTOM} AS "customHooks", {STATES} AS "stateVars", {CLASS_STATES} AS "classStateVars", {HANDLERS} AS "eventHandlers",
  {PARENTS} AS "directParents", {CUSTOM} AS "delegatedHooks", {USERS} AS "usedByComponents" FROM anchors x""")
def tmpl_anchor_context(spark, sf):
    g = binding.graph(spark, sf, INTERFACE_LABELS, [*INTERFACE_RELS, "PASSES_PROP"], store=True)
    out = templates.bug_fix(g, g.nodes.where(F.col("label").isin("Function_Component", "Class_Component", "Custom_Hook")))
    return out.select(
        *TOP, flat("acceptedProps", "name", "type", "isRequired"), flat("libraryHooks", "name", "source"), flat("customHooks", "name", "filePath"), flat("stateVars", "name", "type", "defaultValue"),
        flat("classStateVars", "name", "type", "defaultValue"), flat("eventHandlers", "eventType", "handlerName"), flat("directParents", "name", "filePath", "uid"), flat("delegatedHooks", "name", "filePath"),
        flat("usedByComponents", "name", "filePath", "uid"),
    )


@query(f"""WITH {GRAPH_SQL} SELECT {BASE}, {CHILDREN} AS children, {PROPS} AS "acceptedProps", {HOOKS} AS "libraryHooks", {CUSTOM} AS "customHooks", {STATES} AS "stateVars", {CONSUMED} AS "consumedContexts",
  {BELOW} AS "childConsumedContexts" FROM comp x""")
def tmpl_composition(spark, sf):
    g = binding.graph(spark, sf, [*INTERFACE_LABELS, "Context"], [*INTERFACE_RELS, "USES_COMPONENT", "PROVIDES_CONTEXT", "CONSUMES_CONTEXT"], store=True)
    out = templates.feature_addition(g, components_only(g))
    return out.select(
        *TOP, flat("children", "name", "filePath", "uid"), flat("acceptedProps", "name", "type", "isRequired"), flat("libraryHooks", "name", "source"), flat("customHooks", "name", "filePath"),
        flat("stateVars", "name", "type", "defaultValue"), flat("consumedContexts", "name", "providerName", "providerFile"), flat("childConsumedContexts", "name"),
    )


@query(f"""WITH {GRAPH_SQL} SELECT {BASE}, {PROPS} AS "acceptedProps", {CALLERS} AS callers, {HOOKS} AS "libraryHooks", {CUSTOM} AS "customHooks", {SET_STATES} AS "stateVars", {CLASS_STATES} AS "classStateVars",
  {HANDLERS} AS "eventHandlers", {CHILDREN} AS children FROM comp x""")
def tmpl_refactoring(spark, sf):
    g = binding.graph(spark, sf, INTERFACE_LABELS, [*INTERFACE_RELS, "USES_COMPONENT"], store=True)
    out = templates.refactoring(g, components_only(g))
    return out.select(
        *TOP, flat("acceptedProps", "name", "type", "isRequired"), flat("callers", "name", "filePath", "uid"), flat("libraryHooks", "name", "source"), flat("customHooks", "name", "filePath"),
        flat("stateVars", "name", "type", "defaultValue", "setterName"), flat("classStateVars", "name", "type", "defaultValue"), flat("eventHandlers", "eventType", "handlerName"), flat("children", "name", "filePath", "uid"),
    )


@query(f"""WITH {GRAPH_SQL} SELECT r.project_id, s.name AS "routerComponent", s.file_path AS "routerFile", '/' || r.export AS "routePath", false AS "isNested", true AS "isProtected", r.export = 'BUILDING' AS "isLazy",
  r.name AS "targetComponent", r.file_path AS "targetFile" FROM routed r JOIN supp s ON s.id = r.supp""")
def tmpl_routing_table(spark, sf):
    return templates.routing_table(binding.graph(spark, sf, COMPONENT_LABELS, [*PLACE_RELS, "ROUTES_TO"]))


@query(f"""WITH {GRAPH_SQL} SELECT d.project_id, c.name AS "componentName", s.uid AS "callerUid", string_agg(flag, ',' ORDER BY flag) AS "propsPassed"
  FROM deals d JOIN cust c ON c.id = d.cust JOIN supp s ON s.id = d.supp GROUP BY ALL""")
def tmpl_caller_props(spark, sf):
    g = binding.graph(spark, sf, COMPONENT_LABELS, [*PLACE_RELS, "PASSES_PROP"])
    return templates.caller_props(g, g.nodes.where("label = 'Function_Component'")).withColumn("propsPassed", F.array_join("propsPassed", ","))


@query(f"""WITH {GRAPH_SQL} SELECT project_id, uid, {PROPS} AS props, CASE WHEN x.k = 's' THEN 's' || (x.id % 3) || '|flag' ELSE {agg("v || '|int'", "years y WHERE y.id = x.id AND x.k = 'c'")} END AS "stateVars" FROM comp x""")
def tmpl_neighbor_props(spark, sf):
    g = binding.graph(spark, sf, [*COMPONENT_LABELS, "Prop", "State_Variable"], [*PLACE_RELS, "ACCEPTS_PROP", "DECLARES_STATE", "DECLARES_CLASS_STATE"])
    return templates.neighbor_props(g, g.nodes).select("project_id", "uid", flat("props", "name", "type", "isRequired"), flat("stateVars", "name", "type"))


@query(f"""WITH {GRAPH_SQL}, w AS (SELECT {BASE}, {agg("v", "prio p WHERE p.id = x.id AND x.k = 'c'")} AS "propNames",
    CASE WHEN x.k = 'c' THEN x.export ELSE '' END || CASE WHEN x.k = 'c' AND {USED} THEN ';' ELSE '' END || CASE WHEN {USED} THEN 'use' || x.file_path ELSE '' END AS "hookNames",
    CASE WHEN x.k = 's' THEN 's' || (x.id % 3) ELSE {agg("v", "years y WHERE y.id = x.id AND x.k = 'c'")} END AS "stateNames",
    (SELECT count(*) FROM prio p WHERE p.id = x.id AND x.k = 'c') + (SELECT count(*) FROM years y WHERE y.id = x.id AND x.k = 'c') + 1 + CASE WHEN {USED} THEN 1 ELSE 0 END AS weight FROM comp x)
  SELECT * EXCLUDE (weight), CAST(weight AS INTEGER) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, "componentName", "filePath") <= 40""")
def tmpl_project_overview_topn(spark, sf):
    g = binding.graph(spark, sf, INTERFACE_LABELS, INTERFACE_RELS, store=True)
    names = lambda c: F.array_join(c, ";").alias(c)
    return templates.project_overview(g, 40).select(*TOP, names("propNames"), names("hookNames"), names("stateNames"), "weight")


@query(f"""WITH {GRAPH_SQL} SELECT c.project_id, c.uid AS owner, c.export AS hook, 'segment' AS source, c.id % 4 + 1 AS count FROM cust c""")
def tmpl_hook_edges(spark, sf):
    return templates.hook_edges(binding.graph(spark, sf, [*COMPONENT_LABELS, "Library_Hook"], ["USES_LIBRARY_HOOK"]))


@query(f"""WITH {GRAPH_SQL} SELECT project_id, export || '::segment' AS uid, export AS name, 'segment' AS source FROM (SELECT DISTINCT project_id, export FROM cust)""")
def tmpl_orphan_hooks(spark, sf):
    """No library of the bound graph has the hooks' source, so all are orphans; tests hold the other case."""
    return templates.orphan_hooks(binding.graph(spark, sf, ["Library_Hook", "Project"], ["BELONGS_TO"]).nodes)


@query(f"""WITH {GRAPH_SQL} SELECT DISTINCT project_id FROM place WHERE project_id = (SELECT min(r_name) FROM region)""")
def tmpl_resolve_project(spark, sf):
    nodes = binding.graph(spark, sf, ["Project", "File"], ["BELONGS_TO"]).nodes
    first = table(spark, sf, "region").agg(F.min("r_name").alias("name"))
    return templates.resolve_project(nodes, first.first()["name"])


@query("""SELECT r_name AS project_id, n_name AS file_path FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_files(spark, sf):
    return graph.files_of(binding.graph(spark, sf, ["File", "Project"], ["BELONGS_TO"]))


@query(f"""WITH {GRAPH_SQL} SELECT label, CAST(n AS BIGINT) AS n FROM (SELECT label, count(*) AS n FROM comp WHERE project_id <> (SELECT min(r_name) FROM region) GROUP BY label)
  UNION ALL SELECT 'DEFINED_IN', count(*) FROM anchors WHERE project_id <> (SELECT min(r_name) FROM region)""")
def graph_drop_project(spark, sf):
    g = binding.graph(spark, sf, ["Function_Component", "Class_Component"], ["DEFINED_IN"])
    left = graph.drop_project(g, table(spark, sf, "region").agg(F.min("r_name")).first()[0])
    return graph.label_counts(left.nodes).unionByName(graph.edge_type_counts(left.edges).withColumnRenamed("rel", "label"))


@query(f"""WITH {GRAPH_SQL} SELECT project_id, uid, name IN (SELECT max(name) FROM supp) AS is_root FROM comp""")
def graph_set_root(spark, sf):
    nodes = binding.graph(spark, sf, ["Function_Component", "Class_Component"], ["BELONGS_TO"]).nodes
    top = nodes.where("label = 'Class_Component'").agg(F.max("name").alias("name"))
    roots = nodes.join(top, "name", "left_semi").select("project_id", "name")
    return graph.set_root(nodes, roots).select("project_id", "uid", (F.col("props")["isRoot"] == "true").alias("is_root"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_last_writer_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return graph.last_writer(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT l.user_id, l.event_type, l.value, f.event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) l
  JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) f USING (user_id, event_type) WHERE l.n = 1 AND f.n = 1""")
def upsert_set_once_on_create(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("seq"), "event_id", "value")
    return graph.last_writer(e, ["user_id", "event_type"], ["ts", "seq"], once=["event_id"]).drop("ts", "seq")


@query("""SELECT 'all' AS project_id, l_orderkey AS src_id, l_partkey AS dst_id, 'CONTAINS' AS rel, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey
  JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON l_partkey = p_partkey GROUP BY ALL""")
def merge_drop_missing_endpoint(spark, sf):
    nodes = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node_id")).withColumn("side", F.lit("o")).unionByName(table(spark, sf, "part").where("p_size <= 25").select((-F.col("p_partkey") - 1).alias("node_id")).withColumn("side", F.lit("p")))
    edge = table(spark, sf, "lineitem").select(F.lit("all").alias("project_id"), F.col("l_orderkey").alias("src_id"), (-F.col("l_partkey") - 1).alias("dst_id"), F.lit("CONTAINS").alias("rel"))
    kept = graph.with_endpoints(edge, nodes.withColumn("project_id", F.lit("all")))
    return kept.groupBy("project_id", "src_id", (-F.col("dst_id") - 1).alias("dst_id"), "rel").agg(F.count("*").alias("n"))


@query(f"""WITH {GRAPH_SQL} SELECT x.project_id, x.label, count(*) AS n FROM (SELECT project_id, uid FROM cust UNION ALL SELECT project_id, uid FROM supp) p JOIN comp x USING (project_id, uid) GROUP BY ALL""")
def polymorphic_endpoint_coalesce(spark, sf):
    comps = binding.components(spark, sf)
    pairs = comps.select("project_id", F.col("uid").alias("src_uid"), F.col("uid").alias("dst_uid"), "props")
    both = ("Function_Component", "Class_Component")
    found = graph.edges_from_uids(pairs, comps, "SELF", both, both)
    return found.join(comps.select("project_id", F.col("node_id").alias("src_id"), "label"), ["project_id", "src_id"]).groupBy("project_id", "label").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_ids(spark, sf):
    return graph.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# Joins


@query("""SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def orphan_anti_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""SELECT lang AS project_id, CAST(doc_id AS VARCHAR) AS file_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def resume_pending_anti_join(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("file_path"))
    empty = spark.createDataFrame([], "project_id string, file_path string, stage string, llm_results string")
    done = docs.join(table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("file_path")).distinct(), "file_path", "left_semi").select("project_id", "file_path", F.lit("completed").alias("stage"), F.lit("{}").alias("llm_results"))
    return progress.pending(progress.mark(progress.register(empty, docs), done))


@query("""SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents d JOIN labels l USING (doc_id))""")
def cache_miss_anti_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cached = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("key").distinct()
    return progress.misses(docs.select("key"), cached)


@query("""SELECT doc_id, a.v AS left_v, b.v AS right_v, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'extra' ELSE 'wrong' END AS kind FROM
  (SELECT doc_id, CAST(n_chars > 1500 AS INTEGER) AS v FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id, max(quality) AS v FROM labels GROUP BY doc_id) b USING (doc_id)
  WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.v IS DISTINCT FROM b.v""")
def full_outer_diff_missing_extra_wrong(spark, sf):
    left = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("v"))
    right = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("v"))
    return evaluation.differences(left, right, ["doc_id"], "v")


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages),
  p AS (SELECT DISTINCT split_part(u, '/', 1) AS prefix, 'host' AS target FROM u UNION SELECT DISTINCT split_part(u, '/', 1) || '/' || split_part(u, '/', 2), 'section' FROM u WHERE u LIKE '%/en/%'),
  m AS (SELECT page_id, prefix, target, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS n FROM u JOIN p ON u = prefix OR starts_with(u, prefix || '/'))
  SELECT page_id, prefix, target FROM m WHERE n = 1""")
def alias_longest_prefix(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("u"))
    head = F.substring_index("u", "/", 1)
    hosts = pages.select(head.alias("prefix"), F.lit("host").alias("target"))
    sections = pages.where(F.col("u").contains("/en/")).select(F.substring_index("u", "/", 2).alias("prefix"), F.lit("section").alias("target"))
    return resolve.longest_prefix(pages, "u", hosts.unionByName(sections).distinct()).drop("u")


@query("""SELECT CASE WHEN p_name = 'small bolt' THEN 'exact' WHEN starts_with(p_name, 'small ') THEN 'little' WHEN starts_with(p_name, 's') THEN 'other-s' ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY 1""")
def category_lookup(spark, sf):
    parts = table(spark, sf, "part")
    return parts.groupBy(resolve.category(parts, "p_name", {"small bolt": "exact"}, {"small ": "little", "s": "other-s"}).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def task_match_contains(spark, sf):
    return resolve.contained_specs(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "text", "text", "doc_id", "item_id")


@query("""SELECT d.doc_id, min(b.item_id) AS item_id, count(*) AS hits FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1""")
def task_match_single_hit(spark, sf):
    return task_match_contains(spark, sf).groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count("*").alias("hits"))


# Cost

PRICED_SQL = f"""WITH {CALLS_SQL}, {PRICES_SQL}, priced AS (SELECT c.*, CASE WHEN input_tokens = 0 AND output_tokens = 0 THEN 0 ELSE input_tokens / 1e6 * usd_in + output_tokens / 1e6 * usd_out END AS usd
  FROM calls c LEFT JOIN prices p ON c.model_id = p.model_id AND c.provider IS NOT DISTINCT FROM p.provider)"""
TALLY = "count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(usd), 10) AS usd"


def priced(spark, sf) -> DataFrame:
    return cost.priced(binding.calls(spark, sf), cost.price_table(spark, binding.PRICES), "provider", strict=False)


def rounded(df: DataFrame, *names: str, digits: int = 10) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names or ("usd",)})


@query(f"{PRICED_SQL} SELECT model_id, provider, {TALLY}, count(*) FILTER (usd IS NULL) AS unpriced FROM priced GROUP BY ALL")
def price_lookup_nullsafe(spark, sf):
    df = priced(spark, sf)
    return rounded(cost.tally(df, "model_id", "provider").join(df.groupBy("model_id", "provider").agg(F.count_if(F.col("usd").isNull()).alias("unpriced")).select(F.col("model_id").alias("m"), F.col("provider").alias("p"), "unpriced"), F.col("model_id").eqNullSafe(F.col("m")) & F.col("provider").eqNullSafe(F.col("p"))).drop("m", "p"))


@query(f"{PRICED_SQL} SELECT run_id, model_id, condition_id, task_id, call_purpose, {TALLY} FROM priced GROUP BY ALL")
def cost_by_purpose(spark, sf):
    return rounded(cost.by_purpose(priced(spark, sf)))


@query(f"{PRICED_SQL} SELECT substr(timestamp, 1, 10) AS day, model_id, provider, {TALLY} FROM priced WHERE input_tokens > 0 OR output_tokens > 0 GROUP BY ALL")
def cost_by_day(spark, sf):
    return rounded(cost.by_day(priced(spark, sf), "provider"))


@query(f"""{PRICED_SQL}, r AS (SELECT condition_id, unnest(CASE WHEN task_id IS NULL THEN [NULL] ELSE [task_id, NULL] END) AS task_id, call_purpose, usd, input_tokens, output_tokens FROM priced)
  SELECT condition_id, task_id, call_purpose, {TALLY} FROM r GROUP BY ALL""")
def cost_task_totals_once(spark, sf):
    return rounded(cost.tally(cost.with_totals(priced(spark, sf)), "condition_id", "task_id", "call_purpose"))


@query(f"""{PRICED_SQL} SELECT substr(timestamp, 1, 10) AS day, round(sum(usd), 10) AS usd, count(*) FILTER (usd IS NULL) AS unpriced_calls, CAST(sum(CASE WHEN usd IS NULL THEN input_tokens + output_tokens END) AS BIGINT) AS unpriced_tokens FROM priced GROUP BY 1""")
def cost_unpriced_apart(spark, sf):
    return rounded(cost.unpriced(priced(spark, sf)))


@query("""WITH m AS (SELECT c_mktsegment AS segment, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), lo AS (SELECT min(v) AS own FROM m)
  SELECT segment, CASE WHEN v - own > 0 THEN round(1e6 / (v - own), 4) END AS tasks FROM m, lo""")
def breakeven(spark, sf):
    means = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.avg("o_totalprice").alias("v"))
    low = means.agg(F.min("v").alias("own"))  # one row
    return means.crossJoin(low).select("segment", F.round(cost.break_even(F.lit(1e6), F.col("own"), F.col("v")), 4).alias("tasks"))


@query(f"""WITH {RESULTS_SQL}, s AS (SELECT condition, avg(CASE WHEN outcome = 'passed' THEN 1.0 ELSE 0 END) AS rate, avg(duration_ms) AS usd FROM graded GROUP BY 1)
  SELECT condition, CASE WHEN rate > 0 THEN round(usd / rate, 3) ELSE 'infinity'::DOUBLE END AS usd_per_pass FROM s""")
def cost_per_pass(spark, sf):
    s = evaluation.graded(binding.results(spark, sf)).groupBy("condition").agg(F.avg((F.col("outcome") == "passed").cast("double")).alias("rate"), F.avg("duration_ms").alias("usd"))
    return s.select("condition", F.round(cost.per_pass(F.col("usd"), F.col("rate")), 3).alias("usd_per_pass"))


@query(f"""WITH {CALLS_SQL} SELECT model_id AS stage, condition_id AS prompt_id, CAST(grouping(model_id, condition_id) AS INTEGER) AS level, count(*) FILTER (call_purpose <> 'generator') AS calls_api, count(*) FILTER (call_purpose = 'generator') AS calls_cache_hit,
  CAST(coalesce(sum(input_tokens) FILTER (call_purpose <> 'generator'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens) FILTER (call_purpose <> 'generator'), 0) AS BIGINT) AS output_tokens
  FROM calls GROUP BY GROUPING SETS ((), (model_id), (condition_id))""")
def usage_grouping_sets(spark, sf):
    zero = F.lit(0).cast("bigint")
    log = binding.calls(spark, sf).select(
        F.col("model_id").alias("stage"), F.col("condition_id").alias("prompt_id"), (F.col("call_purpose") == "generator").alias("cache_hit"), F.lit(1).alias("attempts"), F.lit(None).cast("struct<error_type:string,message:string>").alias("error"), F.lit(0.0).alias("latency_ms"),
        F.struct("input_tokens", "output_tokens", zero.alias("cache_read_input_tokens"), zero.alias("cache_creation_input_tokens")).alias("usage"),
    )
    return cost.usage_buckets(log).select("stage", "prompt_id", F.col("level").cast("int").alias("level"), "calls_api", "calls_cache_hit", "input_tokens", "output_tokens")


@query(f"""WITH {CALLS_SQL} SELECT event_id, user_id, first_value(task_id IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS task_id FROM calls
  QUALIFY first_value(task_id IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) IS NOT NULL""")
def carry_forward_attribution(spark, sf):
    calls = binding.calls(spark, sf).withColumn("seq", F.struct("timestamp", "event_id"))
    return cost.attributed(calls, ["user_id"], "seq").select("event_id", "user_id", "task_id")


# Evaluation

COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in evaluation.OUTCOMES)


@query(f"WITH {RESULTS_SQL} SELECT condition, task_id, {COUNTS}, count(*) AS n FROM graded GROUP BY ALL")
def outcome_grade_pivot(spark, sf):
    return evaluation.outcome_counts(evaluation.graded(binding.results(spark, sf)), "condition", "task_id")


@query(f"WITH {RESULTS_SQL} SELECT condition, task_id, CAST(grouping(condition, task_id) AS INTEGER) AS level, {COUNTS}, count(*) AS n FROM graded GROUP BY ROLLUP (condition, task_id)")
def outcome_rollup(spark, sf):
    return evaluation.outcome_rollup(evaluation.graded(binding.results(spark, sf)), "condition", "task_id").withColumn("level", F.col("level").cast("int"))


@query(f"""WITH {RESULTS_SQL} SELECT condition, task_id, CAST(grouping(condition, task_id) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (stage = 'test_pass' AND apply_mode IN ('strict', 'exact_unique')) AS passed,
  count(*) FILTER (stage = 'test_pass' AND apply_mode NOT IN ('strict', 'exact_unique')) AS unverified_passes, count(*) FILTER (apply_mode = 'recount_c0') AS quarantined, count(*) FILTER (stage = 'harness_error') AS harness_errors
  FROM results GROUP BY GROUPING SETS ((condition), (condition, task_id))""")
def condition_summary(spark, sf):
    return evaluation.condition_summary(binding.results(spark, sf)).withColumn("level", F.col("level").cast("int"))


@query(f"WITH {RESULTS_SQL} SELECT task_id, condition, stage, apply_mode, count(*) AS n FROM results GROUP BY ALL")
def stage_matrix(spark, sf):
    return evaluation.stage_matrix(binding.results(spark, sf))


@query("SELECT lang, source, count(DISTINCT sha256(text)) AS distinct_outputs, count(*) AS n FROM documents GROUP BY ALL")
def distinct_output_hashes(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.countDistinct(F.sha2("text", 256)).alias("distinct_outputs"), F.count("*").alias("n"))


@query("""SELECT o_orderpriority, c_mktsegment, p_type, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT p_type FROM part)) g
  LEFT JOIN (SELECT o_orderpriority, c_mktsegment, p_type, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL) USING (o_orderpriority, c_mktsegment, p_type)
  WHERE coalesce(n, 0) <> 80""")
def expected_grid_gaps(spark, sf):
    o, c, p, li = (table(spark, sf, t) for t in ("orders", "customer", "part", "lineitem"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    grid = o.select("o_orderpriority").distinct().crossJoin(c.select("c_mktsegment").distinct()).crossJoin(p.select("p_type").distinct())  # a design of 5 x 5 x 6
    return evaluation.gaps(rows, grid, ["o_orderpriority", "c_mktsegment", "p_type"], 80)


@query("SELECT lang, count(n_chars) AS n, min(n_chars) AS least, median(n_chars) AS median, max(n_chars) AS greatest FROM documents GROUP BY 1")
def median_tokens(spark, sf):
    return evaluation.timing(table(spark, sf, "documents"), "n_chars", "lang")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, CAST(ceil(3 * quantile_cont(o_totalprice, 0.95)) AS BIGINT) AS timeout FROM orders GROUP BY 1")
def p95_timeout(spark, sf):
    return rounded(evaluation.timeouts(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), "p95", digits=4)


@query("SELECT l_returnflag, median(v) AS median FROM (SELECT l_returnflag, l_linenumber::DOUBLE AS v, unnest(range(CAST(l_quantity AS BIGINT))) FROM lineitem) GROUP BY 1")
def weighted_median(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("v", F.col("l_linenumber").cast("double")).withColumn("w", F.col("l_quantity").cast("bigint"))
    return evaluation.weighted_median(lines.where("w > 0"), "v", "w", "l_returnflag")


@query("""WITH t AS (SELECT event_type, user_id % 10 AS rep, sum(value) AS v FROM events WHERE user_id % 10 <> 0 GROUP BY ALL) SELECT event_type, count(v) AS n, round(min(v), 3) AS least, round(median(v), 3) AS median, round(max(v), 3) AS greatest FROM t GROUP BY 1""")
def timing_of_repeats(spark, sf):
    e = table(spark, sf, "events").withColumn("rep", F.col("user_id") % 10).withColumn("warm", F.col("rep") == 0)
    return rounded(evaluation.timing_of_repeats(e, "value", "rep", "event_type", warm_up="warm"), "least", "median", "greatest", digits=3)


@query("""WITH j AS (SELECT lang, source, quality = 1 AS truth, n_chars > 1000 AS said FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT k, g, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM
    (SELECT unnest([{'k': 'all', 'g': '*'}, {'k': 'lang', 'g': lang}, {'k': 'source', 'g': source}], recursive := true), truth, said FROM j) GROUP BY ALL)
  SELECT k AS group_kind, g AS "group", tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) END AS recall,
    CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) END AS f1 FROM c""")
def prf_by_group(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", "source", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1000).alias("said"))
    groups = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("g")) for k, v in (("all", F.lit("*")), ("lang", F.col("lang")), ("source", F.col("source")))]))
    t, s = F.col("truth"), F.col("said")
    counted = j.select(groups.alias("by"), "truth", "said").groupBy(F.col("by.k").alias("group_kind"), F.col("by.g").alias("group")).agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"))
    return rounded(evaluation.precision_recall(counted), "precision", "recall", "f1", digits=9)


@query("""WITH j AS (SELECT lang, (quality = 1) AS a, (n_chars > 1000) AS b FROM documents JOIN labels USING (doc_id)), s AS (SELECT lang, count(*) AS items, count(*) FILTER (a = b) AS agree, avg(a::INT) AS pa, avg(b::INT) AS pb FROM j GROUP BY 1)
  SELECT lang, items, agree, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) = 1 THEN 1.0 ELSE (agree / items - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 9) AS kappa FROM s""")
def cohen_kappa(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("a"), (F.col("n_chars") > 1000).alias("b"))
    return rounded(evaluation.kappa(j, "a", "b", "lang"), "kappa", digits=9)


@query("""SELECT doc_id, lang, CASE WHEN n <= 20 THEN CAST(n AS VARCHAR) ELSE '>20' END AS position FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents)""")
def rank_position_capped(spark, sf):
    d = table(spark, sf, "documents").withColumn("g", F.struct("lang", "source"))
    return rank.rank_position(d, "g", [F.desc("n_chars"), "doc_id"]).select("doc_id", "lang", "position")


@query("SELECT l_returnflag, l_shipdate::VARCHAR AS shipdate, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 5")
def topk_per_group_examples(spark, sf):
    top = evaluation.examples(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return top.select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipdate"), "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS rank FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def reasons_ranked(spark, sf):
    return evaluation.reasons(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("rank", F.col("rank").cast("bigint"))


# Texts and ranking


@query("SELECT doc_id, CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 13 // 10) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


CODE_TERMS = """list_filter(list_transform(flatten(list_transform(list_filter(string_split_regex(coalesce(text, ''), '[^A-Za-z0-9]+'), lambda w: w <> ''),
  lambda w: CASE WHEN len(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) > 1
    THEN list_concat([w], regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) ELSE regexp_extract_all(w, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') END)), lambda t: lower(t)),
  lambda t: len(t) > 1 AND NOT list_contains([""" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "], t))"


@query(f"SELECT doc_id, array_to_string({CODE_TERMS}, ' ') AS terms FROM documents")
def tokenize_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("terms"))


def best_documents(spark: SparkSession, sf: str, terms: lexical.Terms) -> DataFrame:
    scored = rank.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", F.col("text"), "item_id", F.col("text"), terms, k=5, digits=6)
    return scored.withColumn("rank", F.col("rank").cast("bigint"))


def bm25_sql(terms: str) -> str:
    """Scores of documents for the benchmark's items, the best five of each."""
    return f"""WITH d AS (SELECT doc_id, {terms} AS t FROM documents), q AS (SELECT item_id, w, count(*) AS qtf FROM (SELECT item_id, unnest({terms}) AS w FROM benchmark) GROUP BY ALL),
  c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), p AS (SELECT doc_id, len(t) AS dl, w, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
  f AS (SELECT w, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (w) JOIN f USING (w), c GROUP BY ALL)
  SELECT item_id AS query_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5"""


@query(bm25_sql("list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"))
def bm25_rank_topk(spark, sf):
    return best_documents(spark, sf, lexical.PLAIN_TERMS)


@query(bm25_sql(CODE_TERMS))
def bm25_code_terms_topk(spark, sf):
    return best_documents(spark, sf, lexical.CODE_TERMS)


@query("""WITH q AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM q JOIN embeddings v ON v.vec_id = q.vec_id CROSS JOIN embeddings e)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5""")
def dense_cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    chosen = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q")).select("q.*")  # a query a label
    scored = rank.dense_rank(e, chosen, "vec_id", "embedding", "vec_id", "embedding")
    return rank.top_k(scored.withColumn("score", F.round("score", 6)), 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("""WITH RECURSIVE r AS (SELECT lang || '/' || source AS g, doc_id, n_chars AS cost, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
  w AS (SELECT g, k, CASE WHEN cost <= 7000 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 7000 THEN 1 ELSE 0 END AS taken FROM r WHERE k = 1
    UNION ALL SELECT r.g, r.k, CASE WHEN w.used + r.cost <= 7000 THEN w.used + r.cost ELSE w.used END, w.taken + CASE WHEN w.used + r.cost <= 7000 THEN 1 ELSE 0 END FROM w JOIN r ON r.g = w.g AND r.k = w.k + 1)
  SELECT g, arg_max(used, k) AS used, CAST(arg_max(taken, k) AS INTEGER) AS n_included, CAST(max(k) - arg_max(taken, k) AS INTEGER) AS n_skipped FROM w GROUP BY g""")
def budget_first_fit(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), "source").alias("g"), "doc_id", "n_chars", (-F.col("n_chars")).alias("neg"))
    return rank.first_fit(d, "g", ["neg", "doc_id"], "doc_id", "n_chars", 7000).select("g", "used", F.size("included").alias("n_included"), F.size("skipped").alias("n_skipped"))


@query("""SELECT doc_id, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 7000""")
def tail_pop_prefix(spark, sf):
    d = table(spark, sf, "documents").withColumn("g", F.struct("lang", "source"))
    return rank.prefix_within(d, "g", ["n_chars", "doc_id"], "n_chars", 7000).select("doc_id", "n_chars")


@query("""WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS files FROM orders GROUP BY 1), w(solution) AS (VALUES (['F']), (['F', 'O']), (['F', 'O', 'P']), (['P']))
  SELECT o_custkey AS task_id, array_to_string(files, ',') AS files, (SELECT array_to_string(solution, ',') FROM w WHERE len(list_filter(solution, lambda x: NOT list_contains(files, x))) = 0 ORDER BY len(solution), solution LIMIT 1) AS solution FROM s""")
def retention_subset(spark, sf):
    got = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("files")).select(F.lit("t").alias("task_id"), "o_custkey", "files")
    known = spark.createDataFrame([("t", ["F"]), ("t", ["F", "O"]), ("t", ["F", "O", "P"]), ("t", ["P"])], "task_id string, solution array<string>")
    return evaluation.sufficient(got, known).select(F.col("o_custkey").alias("task_id"), F.array_join("files", ",").alias("files"), F.array_join("solution", ",").alias("solution"))


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_props_extract(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT page_id FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS p FROM pages) WHERE p = 'en' OR p LIKE 'en/%'""")
def path_prefix_filter(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/?", "").alias("p"))
    return p.where(paths.under(F.col("p"), "en")).select("page_id")


@query("""SELECT page_id, NOT regexp_matches(name, '^(.*\\.html|.*ref=.*|7.*)$') AS kept FROM (SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages)""")
def glob_exclude(spark, sf):
    name = F.element_at(F.split("url", "/"), -1)
    shapes = "|".join(map(files.glob_pattern, ("*.html", "*ref=*", "7*")))
    return table(spark, sf, "pages").select("page_id", (~name.rlike(f"^({shapes})$")).alias("kept"))


@query("""WITH n AS (SELECT n_name AS name, n_name || '::' || n_regionkey AS uid FROM nation), r AS (SELECT doc_id, 'NATION_' || (doc_id % 30) AS asked FROM documents UNION ALL SELECT doc_id + 1000000000, 'nation_' || (doc_id % 30) FROM documents)
  SELECT doc_id AS request_id, CASE WHEN e.uid IS NOT NULL THEN 'exact' WHEN c.uid IS NOT NULL THEN 'case_insensitive' ELSE 'unresolved' END AS status, coalesce(e.uid, c.uid) AS uid FROM r LEFT JOIN n e ON e.name = asked LEFT JOIN n c ON lower(c.name) = lower(asked)""")
def anchor_resolve_exact_ci(spark, sf):
    return resolve.resolve_anchors(_asked(spark, sf, "NATION_", "nation_"), _nations(spark, sf), fuzzy=False).select("request_id", "status", "uid")


def _nations(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.lit("p").alias("project_id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit("::"), F.col("n_regionkey").cast("string")).alias("uid"), F.lit("").alias("file_path"))


def _asked(spark, sf, *heads: str) -> DataFrame:
    d = table(spark, sf, "documents")
    each = [d.select((F.col("doc_id") + i * 1_000_000_000).alias("request_id"), F.lit("p").alias("project_id"), F.concat(F.lit(h), (F.col("doc_id") % 30).cast("string")).alias("requested")) for i, h in enumerate(heads)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


@query("""WITH r AS (SELECT doc_id, doc_id % 30 AS k FROM documents) SELECT doc_id AS request_id, 'fuzzy' AS status, 'fuzzy' AS matched_by, 'NATION_' || CASE WHEN k < 25 THEN k ELSE k % 10 END AS name,
  CASE WHEN k < 10 THEN 0.875 WHEN k < 25 THEN 0.889 ELSE 0.824 END::DOUBLE AS score FROM r""")
def anchor_resolve_fuzzy(spark, sf):
    """Two letters turned round: all but one of eight or nine agree; where no nation has the number, the greatest name with one of its digits."""
    return resolve.resolve_anchors(_asked(spark, sf, "NATOIN_"), _nations(spark, sf)).select("request_id", "status", "matched_by", "name", "score")


@query("""SELECT doc_id, sha256('m' || chr(0) || coalesce(text, '')) AS key, lower(right(text, 40)) AS tail, CAST(CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, 'the ', ''))) / 4 ELSE 0 END AS INTEGER) AS n_the FROM documents""")
def text_functions(spark, sf):
    t = F.col("text")
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.embedding_key(F.lit("m"), F.coalesce(t, F.lit(""))).alias("key"), F.lower(text.tail(t, 40)).alias("tail"), text.occurrences(t, F.lit("the ")).alias("n_the"))


# Parsers and replays


def _answers(spark, sf) -> DataFrame:
    """Documents as answers: the first line is found and replaced, in every third the search is a word that occurs often."""
    line = F.substring_index("text", "\n", 1)
    search = F.when(F.col("doc_id") % 3 == 0, F.lit("e")).otherwise(line)
    block = F.concat(F.lit("src/doc.txt\n<<<<<<< SEARCH\n"), search, F.lit("\n=======\nnew\n>>>>>>> REPLACE\n"))
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("candidate_id"), F.col("doc_id").cast("string").alias("snapshot"), F.lit("search_replace").alias("format"), block.alias("response"), "text")


@query("""SELECT CAST(doc_id AS VARCHAR) AS candidate_id, 1::INTEGER AS n_edits, 0::INTEGER AS malformed_blocks FROM documents WHERE text IS NOT NULL""")
def edit_parse(spark, sf):
    parsed = edits.parse_answers(_answers(spark, sf))
    return parsed.select("candidate_id", F.size("script.edits").alias("n_edits"), "script.malformed_blocks")


@query("""WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'e' ELSE split_part(text, chr(10), 1) END AS s FROM documents WHERE text IS NOT NULL),
  n AS (SELECT doc_id, s, (length(text) - length(replace(text, s || chr(10), ''))) // (length(s) + 1) AS whole, CASE WHEN s = '' THEN 0 ELSE (length(text) - length(replace(text, s, ''))) // length(s) END AS bare FROM s),
  m AS (SELECT doc_id, CASE WHEN s = '' THEN 1 WHEN whole > 0 THEN whole ELSE bare END AS n FROM n)
  SELECT CAST(doc_id AS VARCHAR) AS candidate_id, CASE WHEN n = 0 THEN 'search_not_found' WHEN n > 1 THEN 'ambiguous_match' END AS first_failure, n = 1 AS would_apply, CASE WHEN n = 1 THEN 1 ELSE 0 END::INTEGER AS accepted FROM m""")
def edit_replay(spark, sf):
    answers = edits.parse_answers(_answers(spark, sf))
    scripts = answers.select("candidate_id", "snapshot", "script.edits", "script.malformed_blocks")
    sources = answers.select("snapshot", F.lit("src/doc.txt").alias("path"), F.col("text").alias("body"))
    return edits.replay_scripts(scripts, sources).select("candidate_id", "replay.first_failure", "replay.would_apply", F.size("replay.accepted").alias("accepted"))


@query(f"WITH {GRAPH_SQL} SELECT label AS kind, CAST(n AS BIGINT) AS n FROM ({NODE_COUNTS}) UNION ALL SELECT rel, CAST(n AS BIGINT) FROM ({EDGE_COUNTS})")
def dump_scan(spark, sf):
    """The bound graph as dump statements, nodes and edges read back and counted."""
    found = dump.statements(binding.graph(spark, sf))
    return graph.label_counts(dump.nodes(found)).unionByName(graph.edge_type_counts(dump.edges(found)).withColumnRenamed("rel", "label")).withColumnRenamed("label", "kind")


@query("""SELECT count(*) AS calls, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type FROM events GROUP BY ALL""")
def usage_by_hour(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("calls")).select("calls", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type")


@query("""SELECT o_custkey, count(*) AS n, sum(CASE WHEN gap THEN 1 ELSE 0 END)::BIGINT AS gaps FROM (SELECT o_custkey, o_orderdate - lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > INTERVAL 90 DAY AS gap FROM orders) GROUP BY 1""")
def sections_between_markers(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumn("gap", F.col("o_orderdate") > F.lag("o_orderdate").over(w) + F.expr("interval 90 days"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if("gap").alias("gaps"))
