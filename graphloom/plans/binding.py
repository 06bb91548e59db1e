"""The fixture tables as a property graph, a corpus, a call log and harness results.

Regions are projects, nations files, customers function components, suppliers class components; each nation has a custom hook, each region a context. An
edge joins nodes of one region only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.operators.graph import Graph, stored

CUSTOMER, SUPPLIER = (k * 1_000_000_000_000 for k in (1, 2))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nationkey, file_path, project_id``."""
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("file_path"), F.col("r_name").alias("project_id"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = places(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.lit("Function_Component").alias("label"), (F.col("c_custkey") + CUSTOMER).alias("node_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("export"))
    s = table(spark, sf_dir, "supplier").select(F.lit("Class_Component").alias("label"), (F.col("s_suppkey") + SUPPLIER).alias("node_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.lit("default").alias("export"))
    both = c.unionByName(s).join(at, "nationkey")
    return both.select("project_id", "node_id", "label", F.concat("name", F.lit("::"), "file_path").alias("uid"), "name", "file_path", F.create_map(F.lit("exportType"), F.col("export")).alias("props"))


def _node(label: str, node_id: Column, uid: Column, name: Column, props: dict[str, Column]) -> list[Column]:
    pairs = [x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]
    return [F.col("project_id"), node_id.alias("node_id"), F.lit(label).alias("label"), uid.alias("uid"), name.alias("name"), F.lit(None).cast("string").alias("file_path"), F.create_map(*pairs).alias("props")]


def _edge(rel: str, src: Column, dst: Column, props: dict[str, Column] | None = None) -> list[Column]:
    pairs = [x for k, v in (props or {}).items() for x in (F.lit(k), v.cast("string"))]
    return [F.col("project_id"), src.alias("src_id"), dst.alias("dst_id"), F.lit(rel).alias("rel"), F.create_map(*pairs).cast("map<string,string>").alias("props")]


def _nodes(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Frames of nodes by label, made when asked for."""
    at, comps = places(spark, sf_dir), components(spark, sf_dir)
    fact = lambda column, kind: _facts(spark, sf_dir, column, kind)
    uid = lambda: F.concat("v", F.lit("::"), "uid")
    node = lambda f, *given: f().select(*_node(*given))
    own_id = F.col("node_id")
    return {
        "Project": lambda: at.select("project_id").distinct().select(*_node("Project", F.xxhash64(F.lit("project"), "project_id"), F.col("project_id"), F.col("project_id"), {"name": F.col("project_id")})),
        "File": lambda: at.select("project_id", F.xxhash64(F.lit("file"), "file_path").alias("node_id"), F.lit("File").alias("label"), F.col("file_path").alias("uid"), F.col("file_path").alias("name"), "file_path", F.create_map(F.lit("filePath"), F.col("file_path")).alias("props")),
        "Function_Component": lambda: comps.where("label = 'Function_Component'"),
        "Class_Component": lambda: comps.where("label = 'Class_Component'"),
        "Custom_Hook": lambda: _hooks(at).select("project_id", "node_id", F.lit("Custom_Hook").alias("label"), "uid", "name", "file_path", F.create_map(F.lit("exportType"), F.lit("named")).alias("props")),
        "Context": lambda: at.select("project_id").distinct().select(*_node("Context", F.xxhash64(F.lit("context"), "project_id"), F.concat(F.lit("Ctx::"), "project_id"), F.concat(F.lit("Ctx"), "project_id"), {"defaultValue": F.lit("null")})),
        "Prop": lambda: node(lambda: fact(F.col("o_orderpriority"), "prop"), "Prop", own_id, uid(), F.col("v"), {"type": F.lit("order"), "isRequired": F.col("v").startswith("1")}),
        "EventHandler": lambda: node(lambda: fact(F.col("o_orderstatus"), "handler"), "EventHandler", own_id, uid(), F.concat(F.lit("on"), "v"), {"eventType": F.col("v")}),
        "State_Variable": lambda: node(lambda: _years(spark, sf_dir), "State_Variable", own_id, uid(), F.col("v"), {"type": F.lit("int")}).unionByName(
            node(lambda: _class_state(comps), "State_Variable", own_id, uid(), F.col("v"), {"type": F.lit("flag"), "defaultValue": F.lit("0")})
        ),
        "Library_Hook": lambda: node(lambda: _segments(comps).select("project_id", "node_id", "v").distinct(), "Library_Hook", own_id, F.concat("v", F.lit("::segment")), F.col("v"), {"source": F.lit("segment")}),
    }


def _facts(spark: SparkSession, sf_dir: str, column: Column, kind: str) -> DataFrame:
    """``project_id, cust, uid, v, node_id`` for each different value of a customer's orders."""
    own = components(spark, sf_dir).where("label = 'Function_Component'").select("project_id", F.col("node_id").alias("cust"), "uid")
    orders = table(spark, sf_dir, "orders").withColumn("cust", F.col("o_custkey") + CUSTOMER)
    return orders.join(own, "cust").select("project_id", "cust", "uid", column.alias("v")).distinct().withColumn("node_id", F.xxhash64(F.lit(kind), "cust", "v"))


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, F.concat(F.lit("y"), F.year("o_orderdate").cast("string")), "state")


def _class_state(comps: DataFrame) -> DataFrame:
    own = comps.where("label = 'Class_Component'").select("project_id", F.col("node_id").alias("supp"), "uid")
    return own.withColumn("v", F.concat(F.lit("s"), ((F.col("supp") - SUPPLIER) % 3).cast("string"))).withColumn("node_id", F.xxhash64(F.lit("flag"), "supp"))


def _segments(comps: DataFrame) -> DataFrame:
    return comps.where("label = 'Function_Component'").select("project_id", F.col("node_id").alias("cust"), F.col("props")["exportType"].alias("v")).withColumn("node_id", F.xxhash64(F.lit("hook"), "project_id", "v"))


def _hooks(at: DataFrame) -> DataFrame:
    name = F.concat(F.lit("use"), "file_path")
    return at.select("project_id", F.xxhash64(F.lit("own"), "file_path").alias("node_id"), F.concat(name, F.lit("::"), "file_path").alias("uid"), name.alias("name"), "file_path")


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project_id, cust, supp, l_returnflag``: what suppliers of a customer's own region have sent."""
    comps = components(spark, sf_dir)
    cust = comps.where("label = 'Function_Component'").select("project_id", (F.col("node_id") - CUSTOMER).alias("o_custkey"), F.col("node_id").alias("cust"))
    supp = comps.where("label = 'Class_Component'").select("project_id", F.col("node_id").alias("supp"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + SUPPLIER).alias("supp"), "l_returnflag").distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return orders.join(cust, "o_custkey").join(lines, "l_orderkey").join(supp, ["project_id", "supp"]).select("project_id", "cust", "supp", "l_returnflag").distinct()


def _edges(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Frames of edges by relationship, made when asked for."""
    at, comps = places(spark, sf_dir), components(spark, sf_dir)
    file_id, context, node, cust, supp = F.xxhash64(F.lit("file"), "file_path"), F.xxhash64(F.lit("context"), "project_id"), F.col("node_id"), F.col("cust"), F.col("supp")
    first = lambda: comps.where("label = 'Class_Component'").groupBy("project_id", "file_path").agg(F.min("node_id").alias("supp"))
    every = lambda n, k: ((F.col("label") == "Function_Component") & ((node - CUSTOMER) % n == 0)) | ((F.col("label") == "Class_Component") & ((node - SUPPLIER) % k == 0))
    facts = lambda column, kind, rel: _facts(spark, sf_dir, column, kind).select(*_edge(rel, cust, node))
    return {
        "BELONGS_TO": lambda: at.select(*_edge("BELONGS_TO", file_id, F.xxhash64(F.lit("project"), "project_id"))),
        "DEFINED_IN": lambda: comps.select("project_id", "node_id", "file_path").unionByName(_hooks(at).select("project_id", "node_id", "file_path")).select(*_edge("DEFINED_IN", node, file_id)),
        "ACCEPTS_PROP": lambda: facts(F.col("o_orderpriority"), "prop", "ACCEPTS_PROP"),
        "HAS_HANDLER": lambda: facts(F.col("o_orderstatus"), "handler", "HAS_HANDLER"),
        "DECLARES_STATE": lambda: _years(spark, sf_dir).select(*_edge("DECLARES_STATE", cust, node)),
        "DECLARES_CLASS_STATE": lambda: _class_state(comps).select(*_edge("DECLARES_CLASS_STATE", supp, node)),
        "USES_LIBRARY_HOOK": lambda: _segments(comps).select(*_edge("USES_LIBRARY_HOOK", cust, node, {"count": cust % 4 + 1})),
        "USES_CUSTOM_HOOK": lambda: comps.where(every(3, 2)).select(*_edge("USES_CUSTOM_HOOK", node, F.xxhash64(F.lit("own"), "file_path"))),
        "PROVIDES_CONTEXT": lambda: first().select(*_edge("PROVIDES_CONTEXT", supp, context)),
        "CONSUMES_CONTEXT": lambda: comps.where(every(5, 3)).select(*_edge("CONSUMES_CONTEXT", node, context)),
        "USES_COMPONENT": lambda: _deals(spark, sf_dir).select("project_id", "cust", "supp").distinct().select(*_edge("USES_COMPONENT", cust, supp)),
        "PASSES_PROP": lambda: _deals(spark, sf_dir).select(*_edge("PASSES_PROP", supp, cust, {"propName": F.col("l_returnflag")})),
        "ROUTES_TO": lambda: comps.where("label = 'Function_Component'").join(first().drop("project_id"), "file_path").select(
            *_edge("ROUTES_TO", supp, node, {"path": F.concat(F.lit("/"), F.col("props")["exportType"]), "isNested": F.lit(False), "isLazy": F.col("props")["exportType"] == "BUILDING", "isProtected": F.lit(True)})
        ),
    }


def graph(spark: SparkSession, sf_dir: str, labels: Sequence[str] | None = None, rels: Sequence[str] | None = None, store: bool = False) -> Graph:
    """The graph, or only the labels and relationships asked for; written by them if several steps read it (``store``).

    Customers accept a prop for each priority of their orders, handle each status, keep a state variable for each year, use a library hook for their
    segment and the suppliers of their orders; these pass them the return flags of what they supplied, keep class state, and route to the customers of their nation.
    Every third customer and every second supplier use their nation's hook, every fifth customer and every third supplier consume their region's context, which
    each nation's first supplier provides."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)

    def union(makers: dict, names: Sequence[str] | None) -> DataFrame:
        out = None
        for name in makers if names is None else names:
            out = makers[name]() if out is None else out.unionByName(makers[name]())
        return out

    made = Graph(union(nodes, labels), union(edges, rels))
    return stored(made) if store else made


GRAPH_SQL = """
place AS (SELECT n_nationkey, n_name AS file_path, r_name AS project_id FROM nation JOIN region ON n_regionkey = r_regionkey),
comp AS (
  SELECT project_id, 'Function_Component' AS label, c_custkey AS id, 'c' AS k, c_name AS name, file_path, c_name || '::' || file_path AS uid, c_mktsegment AS export FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT project_id, 'Class_Component', s_suppkey, 's', s_name, file_path, s_name || '::' || file_path, 'default' FROM supplier JOIN place ON s_nationkey = n_nationkey),
cust AS (SELECT * FROM comp WHERE k = 'c'), supp AS (SELECT * FROM comp WHERE k = 's'),
prio AS (SELECT DISTINCT project_id, id, uid, o_orderpriority AS v FROM orders JOIN cust ON o_custkey = id),
status AS (SELECT DISTINCT project_id, id, uid, o_orderstatus AS v FROM orders JOIN cust ON o_custkey = id),
years AS (SELECT DISTINCT project_id, id, uid, 'y' || year(o_orderdate) AS v FROM orders JOIN cust ON o_custkey = id),
deals AS (SELECT DISTINCT c.project_id, c.id AS cust, s.id AS supp, l_returnflag AS flag FROM orders JOIN cust c ON o_custkey = c.id JOIN lineitem ON l_orderkey = o_orderkey JOIN supp s ON l_suppkey = s.id AND s.project_id = c.project_id),
uses AS (SELECT DISTINCT project_id, cust, supp FROM deals),
hooks AS (SELECT project_id, 'use' || file_path AS name, file_path, 'use' || file_path || '::' || file_path AS uid FROM place),
hooked AS (SELECT * FROM comp WHERE (k = 'c' AND id % 3 = 0) OR (k = 's' AND id % 2 = 0)),
consumers AS (SELECT * FROM comp WHERE (k = 'c' AND id % 5 = 0) OR (k = 's' AND id % 3 = 0)),
firsts AS (SELECT project_id, file_path, min(id) AS id FROM supp GROUP BY ALL),
providers AS (SELECT f.project_id, s.name, s.file_path FROM firsts f JOIN supp s ON s.id = f.id),
anchors AS (SELECT project_id, label, id, k, name, file_path, uid, export FROM comp UNION ALL SELECT project_id, 'Custom_Hook', 0, 'h', name, file_path, uid, '' FROM hooks),
routed AS (SELECT c.*, f.supp FROM cust c JOIN (SELECT file_path, min(id) AS supp FROM supp GROUP BY file_path) f USING (file_path))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged calls: the type is the model, ``k`` the output tokens, a purchase carries its id as task."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id", F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run_id"), F.col("event_type").alias("model_id"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("provider"),
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("condition_id"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string"))).alias("task_id"),
        F.when(F.col("event_type") == "click", "generator").otherwise("classifier").alias("call_purpose"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 1000).cast("bigint").alias("input_tokens"), F.when(F.col("event_type") == "error", F.lit(0)).otherwise(k).cast("bigint").alias("output_tokens"), "user_id", "value",
    )


CALLS_SQL = """
calls AS (SELECT event_id, 'run' || (user_id % 4) AS run_id, event_type AS model_id, CASE WHEN user_id % 3 <> 0 THEN 'p' || (user_id % 3) END AS provider, 'c' || (user_id % 5) AS condition_id,
  CASE WHEN event_type = 'purchase' THEN 't' || (event_id % 7) END AS task_id, CASE WHEN event_type = 'click' THEN 'generator' ELSE 'classifier' END AS call_purpose,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 1000 END AS input_tokens,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS output_tokens, user_id, value FROM events)"""

# Prices of the bound call log: models and providers as the log has them; signups are not priced.
PRICES = [("view", None, 1.0, 2.0), ("view", "p1", 1.5, 2.5), ("view", "p2", 0.5, 4.0), ("click", None, 3.0, 15.0), ("click", "p1", 0.25, 1.75), ("click", "p2", 2.0, 8.0), ("purchase", None, 0.5, 0.0), ("purchase", "p1", 0.75, 0.0)]
PRICES_SQL = "prices(model_id, provider, usd_in, usd_out) AS (VALUES " + ", ".join(f"('{m}', {'NULL' if p is None else repr(p)}, {a}::DOUBLE, {b}::DOUBLE)" for m, p, a, b in PRICES) + ")"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as harness results: status and priority give stage and mode."""
    o = table(spark, sf_dir, "orders")
    low = F.col("o_orderpriority").startswith("5")
    stage = F.when(F.col("o_orderstatus") == "P", F.when(low, "timeout_at_apply").otherwise("diff_apply_fail")).when(F.col("o_orderstatus") == "F", F.when(low, "build_fail").otherwise("test_fail")).otherwise(F.when(F.col("o_custkey") % 50 == 0, "harness_error").otherwise("test_pass"))
    mode = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderpriority").startswith("1"), "recount_c0").when(F.col("o_orderpriority").startswith("2"), "strict").otherwise("exact_unique"))
    return o.select(F.col("o_orderkey").cast("string").alias("candidate_id"), (F.col("o_custkey") % 6).cast("int").alias("task_id"), F.col("o_orderpriority").alias("condition"), stage.alias("stage"), mode.alias("apply_mode"), F.col("o_totalprice").alias("duration_ms"), F.col("o_orderkey").alias("seq"))


RESULTS_SQL = """
results AS (SELECT CAST(o_orderkey AS VARCHAR) AS candidate_id, CAST(o_custkey % 6 AS INTEGER) AS task_id, o_orderpriority AS condition,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority LIKE '5%' THEN 'timeout_at_apply' ELSE 'diff_apply_fail' END
       WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority LIKE '5%' THEN 'build_fail' ELSE 'test_fail' END
       WHEN o_custkey % 50 = 0 THEN 'harness_error' ELSE 'test_pass' END AS stage,
  CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'recount_c0' WHEN o_orderpriority LIKE '2%' THEN 'strict' ELSE 'exact_unique' END END AS apply_mode,
  o_totalprice AS duration_ms, o_orderkey AS seq FROM orders),
graded AS (SELECT *, CASE WHEN stage = 'harness_error' THEN 'harness_error' WHEN apply_mode = 'recount_c0' THEN 'quarantined'
  WHEN stage IN ('diff_apply_fail', 'timeout_at_apply') THEN 'never_applied' WHEN stage = 'build_fail' THEN 'build_fail' WHEN stage = 'test_fail' THEN 'test_fail' ELSE 'passed' END AS outcome FROM results)"""
