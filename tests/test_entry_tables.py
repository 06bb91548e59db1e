"""Records whose lists are tables of entries, as where a file holds more than a row can."""

import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.operators import annotations, build
from graphloom.operators.graph import Graph


@pytest.fixture(scope="module")
def extractions(spark):
    lists = {
        "src/A.tsx": {"components": [("A", "arrow", True, [("useState", "library", "react")] * 2 + [("useB", "library", "./B")], True, "default"), ("Z", "arrow", False, [], True, "named")]},
        "src/B.tsx": {"customHooks": [("useB", "function", "named", [], "")], "eventHandlers": [("onX", "x", "A", True), ("onX", "y", "A", True), ("onX", "z", "A", False), ("onX", "x", "Z", None)]},
        "src/C.tsx": {"props": [("a", "A", "string", None)]},
    }
    return spark.createDataFrame([("p", f, *[own.get(n, []) for n in schemas.EXTRACTION]) for f, own in lists.items()], schemas.EXTRACTIONS)


@pytest.fixture(scope="module")
def tables(extractions):
    return {n: extractions.select("project_id", "file_path", F.posexplode(n).alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint") * (1 << 33)) for n in schemas.EXTRACTION}


@pytest.fixture(scope="module")
def files(extractions):
    return extractions.select("project_id", "file_path")


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame([("p", {}, None)], "project_id string, aliases map<string,string>, base_url string")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_content_is_counted(extractions, tables, files):
    found = rows(build.content(tables, files).select("file_path", "has_content", "components"))
    assert found == rows(extractions.select("file_path", build.has_content(extractions).alias("has_content"), F.size("components").cast("bigint").alias("components")))
    assert found == rows(build.content(extractions, files).select("file_path", "has_content", "components"))


def test_hook_calls_of_entry_tables(extractions, tables, files, projects):
    got = [build.hook_calls(e, projects, files).select("file_path", "component", "hook", "category", "count") for e in (tables, extractions)]
    assert rows(got[0]) == rows(got[1])
    assert {(r.hook, r.category, r["count"]) for r in got[0].collect()} == {("useState", "library", 2), ("useB", "custom", 1)}


def test_hook_calls_of_many_components(spark, files, projects, monkeypatch):
    hooks = [("useB", "library", "./B"), ("useState", "library", "react"), ("useState", "library", "react")]
    listed = [(f"A{n}", "arrow", True, hooks, True, "named") for n in range(40)] + [("A0", "arrow", True, [("useB", "library", "./B"), ("useC", "custom", "./C"), ("useD", "library", "local")], True, "named")]
    records = spark.createDataFrame([("p", "src/A.tsx", *[listed if n == "components" else [] for n in schemas.EXTRACTION])], schemas.EXTRACTIONS)
    asked = []
    monkeypatch.setattr(build, "manifest_files", lambda requests, *rest, f=build.manifest_files: asked.append(requests) or f(requests, *rest))
    calls = build.hook_calls(records, projects, files)
    assert asked[0].count() == 2, "a file's import of a source is looked up once"
    plan = calls._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning") > plan.rindex("Sort"), "calls are dealt out before they are sorted"
    found = {(r.component, r.hook): (r.category, r["count"]) for r in calls.collect()}
    assert len(found) == 82 and calls.count() == 82
    assert found["A0", "useB"] == ("custom", 2) and found["A7", "useB"] == ("custom", 1) and found["A39", "useState"] == ("library", 2) and found["A0", "useC"] == ("custom", 1) and found["A0", "useD"] == ("library", 1)


def test_nodes_of_entry_tables(spark, extractions, tables, files, projects):
    given = projects.select("project_id", F.lit("P").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("main"), "aliases", "base_url")
    known = files.select("*", F.element_at(F.split("file_path", "/"), -1).alias("name"), F.lit("2026").alias("modifiedAt"))
    libs = spark.createDataFrame([("p", "react", "18", "framework", "production")], "project_id string, name string, version string, category string, dependencyType string")
    listed = F.transform(F.sort_array(F.map_keys("props")), lambda k: F.concat(k, F.lit("="), F.col("props")[k])).alias("props")
    nodes = build.graph_nodes(given, known, libs, tables)
    assert rows(nodes.select("label", "uid", listed)) == rows(build.graph_nodes(given, known, libs, extractions).select("label", "uid", listed))
    found = {r.uid: r for r in nodes.collect()}
    assert found["onX_2::A::src/B.tsx"].props == {"uid": "onX_2::A::src/B.tsx", "name": "onX_2", "filePath": "src/B.tsx", "eventType": "y", "componentName": "A", "isInline": "true"}
    assert {u for u in found if u.startswith("onX")} == {"onX::A::src/B.tsx", "onX_2::A::src/B.tsx", "onX::Z::src/B.tsx"} and found["onX::A::src/B.tsx"].props["isInline"] == "false"
    assert found["p"].props == {"projectId": "p", "name": "P"} and found["useB::src/B.tsx"].props["exportType"] == "named"


def test_items_of_a_built_graph(spark):
    node = lambda i, label, name: ("p", i, label, f"{name}::f", name, "f", {"name": name, "filePath": "f"})
    nodes = spark.createDataFrame([node(1, "Function_Component", "A"), node(2, "Class_Component", "B"), ("p", 3, "Project", "p", "p", None, {"name": "p"}), ("p", 4, "Library", "react", "react", None, {"name": "react"})], schemas.NODES)
    edges = spark.createDataFrame([("p", 1, 2, "PASSES_PROP", {}), ("p", 1, 2, "PASSES_PROP", {"propName": "None"}), ("p", 1, 2, "PASSES_PROP", {"propName": "b"}), ("p", 3, 4, "DEPENDS_ON", {})], schemas.EDGES)
    g = Graph(nodes, edges)
    assert rows(annotations.items(g, keyed=True)) == rows(annotations.items(g))
    assert rows(annotations.package_items(g)) == rows(annotations.items(g).where("placement = 'package'"))
    assert [tuple(r) for r in annotations.file_ends(annotations.items(g, keyed=True)).collect()] == [("p", "f", 4, 2, "Function_Component", "PASSES_PROP")]
