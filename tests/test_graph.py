import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.operators import annotations, build, context, graph, resolve, retrieval, templates
from graphloom.sources import dump
from graphloom.sources.store import written

SMALL = r"""
CREATE INDEX ON :Prop(uid);
CREATE (:__mg_vertex__:`Project` {__mg_id__: 0, `projectId`: "p", `name`: "shop"});
CREATE (:__mg_vertex__:`File` {__mg_id__: 1, `filePath`: "src/App.tsx", `name`: "App.tsx"});
CREATE (:__mg_vertex__:`File` {__mg_id__: 2, `filePath`: "src/Empty.tsx", `name`: "Empty.tsx"});
CREATE (:__mg_vertex__:`Function_Component` {__mg_id__: 3, `uid`: "App::src/App.tsx", `name`: "App", `filePath`: "src/App.tsx", `returnsJSX`: true});
CREATE (:__mg_vertex__:`Function_Component` {__mg_id__: 4, `uid`: "Row::src/App.tsx", `name`: "Row", `filePath`: "src/App.tsx"});
CREATE (:__mg_vertex__:`Custom_Hook` {__mg_id__: 5, `uid`: "useCart::src/App.tsx", `name`: "useCart", `filePath`: "src/App.tsx"});
CREATE (:__mg_vertex__:`Library_Hook` {__mg_id__: 6, `uid`: "useState::react", `name`: "useState", `source`: "react"});
CREATE (:__mg_vertex__:`Library` {__mg_id__: 7, `name`: "react", `version`: null});
CREATE (:__mg_vertex__:`Prop` {__mg_id__: 8, `uid`: "label::Row::src/App.tsx", `name`: "label", `componentName`: "Row", `filePath`: "src/App.tsx", `type`: "'a' \"b\" it\'s", `isRequired`: false});
CREATE (:__mg_vertex__:`State_Variable` {__mg_id__: 9, `uid`: "n::App::src/App.tsx", `name`: "n", `componentName`: "App", `filePath`: "src/App.tsx", `type`: "number", `defaultValue`: "0"});
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 1 AND v.__mg_id__ = 0 CREATE (u)-[:`BELONGS_TO`]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 2 AND v.__mg_id__ = 0 CREATE (u)-[:`BELONGS_TO`]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 3 AND v.__mg_id__ = 1 CREATE (u)-[:`DEFINED_IN`]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 4 AND v.__mg_id__ = 1 CREATE (u)-[:`DEFINED_IN`]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 5 AND v.__mg_id__ = 1 CREATE (u)-[:`DEFINED_IN`]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 3 AND v.__mg_id__ = 4 CREATE (u)-[:`PASSES_PROP` {`propName`: "label"}]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 3 AND v.__mg_id__ = 4 CREATE (u)-[:`PASSES_PROP` {`propName`: "onClick"}]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 3 AND v.__mg_id__ = 4 CREATE (u)-[:`USES_COMPONENT` {`usage`: "element"}]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 3 AND v.__mg_id__ = 5 CREATE (u)-[:`USES_CUSTOM_HOOK`]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 3 AND v.__mg_id__ = 6 CREATE (u)-[:`USES_LIBRARY_HOOK` {`count`: 3}]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 6 AND v.__mg_id__ = 7 CREATE (u)-[:`PROVIDED_BY`]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 4 AND v.__mg_id__ = 8 CREATE (u)-[:`ACCEPTS_PROP`]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 3 AND v.__mg_id__ = 9 CREATE (u)-[:`DECLARES_STATE` {`init_is_literal`: true}]->(v);
MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = 3 AND v.__mg_id__ = 3 CREATE (u)-[:`ROUTES_TO` {`path`: "/a b", `isNested`: true}]->(v);
"""


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "shop"
    path.mkdir()
    (path / "full_dump.cypherl").write_text(SMALL)
    g = dump.read(spark, str(path / "full_dump.cypherl"), "p")
    return graph.Graph(written(g.nodes), written(g.edges))


def test_dump(spark, small):
    nodes = {r.node_id: r for r in small.nodes.collect()}
    assert len(nodes) == 10 and small.edges.count() == 14
    assert nodes[8].props["type"] == "'a' \"b\" it's"
    assert nodes[3].props["returnsJSX"] == "true" and nodes[7].props["version"] is None and nodes[8].props["isRequired"] == "false"
    route = small.edges.where("rel = 'ROUTES_TO'").first()
    assert (route.src_id, route.dst_id, route.props["path"]) == (3, 3, "/a b")
    assert {r.label: r.n for r in graph.label_counts(small.nodes).collect()}["File"] == 2
    assert {r.rel: r.n for r in graph.edge_type_counts(small.edges).collect()}["PASSES_PROP"] == 2


def test_dump_round_trip(spark, small, tmp_path):
    dump.write(small, str(tmp_path / "out"))
    again = dump.read(spark, str(tmp_path / "out" / "*" / "*.txt"), "p")
    key = lambda g: (sorted((r.node_id, r.label, r.uid, sorted((r.props or {}).items(), key=str)) for r in g.nodes.collect()), sorted((r.src_id, r.dst_id, r.rel, sorted((r.props or {}).items())) for r in g.edges.collect()))
    assert key(again) == key(small)


def test_templates(small):
    row = templates.ordered(templates.bug_fix(small, ["App", "useCart"], "p")).collect()
    app, hook = row
    assert (app.componentName, hook.componentName, hook.componentType) == ("App", "useCart", "Custom_Hook")
    assert [x.name for x in app.libraryHooks] == ["useState"] and [x.filePath for x in app.delegatedHooks] == ["src/App.tsx"] and app.acceptedProps == []
    assert [x.name for x in hook.usedByComponents] == ["App"]
    ref = templates.refactoring(small, ["Row"], "p").first()
    assert [x.uid for x in ref.callers] == ["App::src/App.tsx"] and ref.acceptedProps[0].isRequired is False
    assert templates.caller_props(small, ["Row"], "p").first().propsPassed == ["label", "onClick"]
    assert templates.routing_table(small, "p").first().routePath == "/a b"
    assert templates.bug_fix(small, [], "p").count() == 0 and templates.bug_fix(small, ["App"], "other").count() == 0
    top = templates.project_overview(small, 1, "p").first()
    assert (top.componentName, top.weight) == ("App", 3)
    assert templates.orphan_hooks(small.nodes).count() == 0
    assert [tuple(r) for r in templates.hook_edges(small).collect()] == [("p", "App::src/App.tsx", "useState", "react", 3)]
    assert templates.anchor_candidates(small, "p").count() == 3


def test_items(small):
    found = annotations.items_by_file(small)
    by = {r.path: r["items"] for r in found.collect()}
    assert set(by) == {"src/App.tsx", "src/Empty.tsx"}
    texts = [r.t for r in found.select("path", F.explode("items").alias("i")).where("path = 'src/App.tsx'").select(annotations.item_text(F.col("i"), F.lit("src/App.tsx")).alias("t")).collect()]
    assert "N Prop:Row::label" in texts and "E ROUTES_TO Function_Component:App -> Function_Component:App path='/a b'" in texts
    assert "E USES_LIBRARY_HOOK Function_Component:App -> Library_Hook:useState@react" in texts and "E PROVIDED_BY Library_Hook:useState@react -> Library:react" in texts
    assert len([t for t in texts if t.startswith("E PASSES_PROP")]) == 2
    for t in texts:
        item = annotations.parse_item(t, "src/App.tsx")
        assert item["kind"] == t[0]
    covered = {r.path: r.types for r in annotations.coverage(annotations.items(small)).collect()}
    assert "Library_Hook" in covered["src/App.tsx"] and "File" not in covered["src/App.tsx"]


def test_context_is_cut_in_order(spark, small):
    rows = written(templates.bug_fix(small, ["App", "Row"], "p"))
    corpus = spark.createDataFrame([("p", "src/App.tsx", "word " * 10)], "project_id string, path string, source string")
    neighbours = written(templates.neighbor_props(small, context.neighbour_uids(rows), "p"))
    full = context.assemble(rows, corpus, "bug_fix", neighbours, budget=7000).first()
    assert [a.name for a in full.assembly.anchors] == ["App", "Row"] and [n.role for n in full.assembly.neighbours] == ["parent"]
    assert [s.name for s in full.assembly.secondary] == ["useCart"]
    tight = context.assemble(rows, corpus, "bug_fix", neighbours, budget=full.tokens - 1).first()
    assert tight.assembly.neighbours == [] and len(tight.assembly.secondary) == 1 and tight.tokens < full.tokens
    least = context.assemble(rows, corpus, "bug_fix", neighbours, budget=0).first()
    assert least.assembly.secondary == [] and all(not a.props and not a.hooks for a in least.assembly.anchors)
    text = context.render(context.assemble(rows, corpus, "bug_fix", neighbours).withColumn("task_type", F.lit("bug_fix"))).first().context
    assert "#### App (`src/App.tsx`)" in text and "renders the target and passes props to it" in text


def test_writers(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, seq int, v string")
    assert sorted((r.k, r.v) for r in graph.last_writer(rows, ["k"], ["seq"]).collect()) == [("a", "y"), ("b", None)]
    assert sorted((r.k, r.v) for r in graph.first_writer(rows, ["k"], ["seq"]).collect()) == [("a", "x"), ("b", None)]
    table = spark.createDataFrame([("a", "old", "first")], "k string, v string, made string")
    new = graph.upsert(table, spark.createDataFrame([("a", "new", "second"), ("c", "n", "m")], "k string, v string, made string"), ["k"], once=["made"])
    assert sorted(tuple(r) for r in new.collect()) == [("a", "new", "first"), ("c", "n", "m")]


ANCHORS = [("CartProduct", "CartProduct::src/a.tsx"), ("CartProducts", "CartProducts::src/b.tsx"), ("useCart", "useCart::src/c.ts"), ("Button", "Button::src/components/Button.tsx"), ("Button", "Button::src/ui/Button.tsx")]


@pytest.mark.parametrize("asked,spec,status,uid", [
    ("CartProduct", "", "exact", "CartProduct::src/a.tsx"), ("cartproduct", "", "case_insensitive", "CartProduct::src/a.tsx"), ("CartPorduct", "", "fuzzy", "CartProduct::src/a.tsx"),
    ("CartProducts", "", "exact", "CartProducts::src/b.tsx"), ("Button", "", "ambiguous", "Button::src/components/Button.tsx"), ("Button", "change src/ui/Button.tsx", "ambiguous", "Button::src/ui/Button.tsx"), ("Foo", "", "unresolved", None),
])
def test_anchor_ladder(spark, asked, spec, status, uid):
    nodes = spark.createDataFrame([("p", n, u, u.split("::")[1]) for n, u in ANCHORS], "project_id string, name string, uid string, file_path string")
    got = resolve.resolve_anchors(spark.createDataFrame([(1, "p", asked, spec)], "request_id int, project_id string, requested string, spec string"), nodes).first()
    assert (got.status, got.uid) == (status, uid)
    if status == "fuzzy":
        assert got.score == 0.909
    if status == "ambiguous":
        assert len(got.alternatives) == 1


def extraction(file, **lists):
    names = list(schemas.EXTRACTION)
    return ("p", file, *[lists.get(n, []) for n in names])


def test_build(spark):
    state = lambda n, c, d: (n, "set" + n, "number", d, c, "hook")
    rows = [
        extraction("src/App.tsx", components=[("App", "arrow", True, [("useState", "library", "react"), ("useState", "library", "react"), ("useCart", "library", "hooks/cart"), ("useX", "library", "x")], True, "default"), ("useLocal", "function", False, [], False, "named")],
                   props=[("a", "App", "string", None)], eventHandlers=[("onClick", "click", "App", True), ("onClick", "click", "App", True), ("onClick_2", "click", "App", True), ("onClick", "click", "App", True)],
                   stateVariables=[state("n", "App", "0"), state("m", "useLocal", "f()")], componentUsages=[("App", "Row", "./Row", "element", [("label", "x"), ("label", "y")]), ("App", "Board", "components/Board", "element", []), ("App", "Ext", "ext-lib", "element", [])],
                   routeDefinitions=[("App", "Row", "./Row", "/one", False, False, False), ("App", "Row", "./Row", "/two", True, False, False)], contextConsumers=[("App", "function_component", "Ctx", "./ctx", "useContext")]),
        extraction("src/Row/index.tsx", components=[("Row", "arrow", False, [], True, "default")]),
        extraction("src/components/Board/index.jsx", components=[("ProjectBoard", "arrow", False, [], True, "default")], classComponents=[("Old", "React.Component", None, "named", True, ["render"], True)], classStateVariables=[("s", None, None, None, "Old", None)]),
        extraction("src/hooks/cart/useCart.ts", customHooks=[("useCart", "function", "named", [], "")], customHookUsages=[("useCart", [("useMemo", "react", 2)], [("useLocal", "../../App")])]),
        extraction("src/ctx.ts", contexts=[("Ctx", "null", "named")], contextProviders=[("Nobody", "Ctx", "same_file", "v")]),
    ]
    extractions = spark.createDataFrame(rows, schemas.EXTRACTIONS)
    files = spark.createDataFrame([("p", r[1], r[1].split("/")[-1], "2026") for r in rows] + [("p", "src/hooks/cart/index.ts", "index.ts", "2026"), ("p", "src/index.tsx", "index.tsx", "2026")], "project_id string, file_path string, name string, modifiedAt string")
    projects = spark.createDataFrame([("p", "shop", None, "/x", None, {}, "src")], "project_id string, name string, description string, file_path string, main string, aliases map<string,string>, base_url string")
    libs = spark.createDataFrame([("p", "react", "18", "framework", "production")], "project_id string, name string, version string, category string, dependencyType string")
    corpus = spark.createDataFrame([("p", "src/index.tsx", "import 'react-dom'; root.render(<StrictMode><App /></StrictMode>)")], "project_id string, path string, source string")
    g = build.build_graph(projects, files, libs, extractions, corpus)
    nodes, edges = g.nodes.cache(), g.edges.cache()
    uid = {r.node_id: r.uid for r in nodes.collect()}
    seen = {(r.rel, uid[r.src_id], uid[r.dst_id]): r.props for r in edges.collect()}
    assert seen["USES_LIBRARY_HOOK", "App::src/App.tsx", "useState::react"]["count"] == "2"
    assert ("USES_CUSTOM_HOOK", "App::src/App.tsx", "useCart::src/hooks/cart/useCart.ts") in seen  # a library by name, a file of the project by its source
    assert seen["USES_LIBRARY_HOOK", "useCart::src/hooks/cart/useCart.ts", "useMemo::react"]["count"] == "2"
    assert ("USES_CUSTOM_HOOK", "useCart::src/hooks/cart/useCart.ts", "useLocal::src/App.tsx") in seen
    assert ("USES_COMPONENT", "App::src/App.tsx", "Row::src/Row/index.tsx") in seen and ("USES_COMPONENT", "App::src/App.tsx", "ProjectBoard::src/components/Board/index.jsx") in seen
    assert seen["ROUTES_TO", "App::src/App.tsx", "Row::src/Row/index.tsx"]["path"] == "/two"
    assert ("CONSUMES_CONTEXT", "App::src/App.tsx", "Ctx::src/ctx.ts") in seen and not any(k[0] == "PROVIDES_CONTEXT" for k in seen)
    assert seen["DECLARES_STATE", "App::src/App.tsx", "n::App::src/App.tsx"]["init_is_literal"] == "true" and seen["DECLARES_STATE", "useLocal::src/App.tsx", "m::useLocal::src/App.tsx"]["init_is_literal"] == "false"
    assert seen["DECLARES_CLASS_STATE", "Old::src/components/Board/index.jsx", "s::Old::src/components/Board/index.jsx"]["declarationStyle"] == "constructor"
    assert ("PROVIDED_BY", "useState::react", "react") in seen and ("RENDERS_ROOT_COMPONENT", "src/index.tsx", "App::src/App.tsx") in seen
    assert sum(k[0] == "PASSES_PROP" for k in seen) == 1
    handlers = {r.name for r in nodes.where("label = 'EventHandler'").collect()}
    assert handlers == {"onClick", "onClick_2", "onClick_2_2", "onClick_3"}
    assert {r.name: r.props["isRoot"] for r in nodes.where("label = 'Function_Component'").collect()} == {"App": "true", "Row": "false", "ProjectBoard": "false"}
    assert nodes.where("label = 'Custom_Hook'").count() == 2 and graph.duplicate_keys(nodes, list(schemas.NODE_KEY)).count() == 0
    assert {r.file_path for r in extractions.where(build.has_content(extractions)).collect()} == {r[1] for r in rows}


@pytest.mark.parametrize("task_type", ["bug_fix", "feature_addition", "refactoring"])
def test_whole_retrievals(spark, small, task_type):
    corpus = spark.createDataFrame([("p", "src/App.tsx", "const App = 1")], "project_id string, path string, source string")
    asked = spark.createDataFrame([(1, "p", "app"), (2, "p", "Row")], "request_id int, project_id string, requested string")
    strict, found = retrieval.graph_contexts(small, corpus, asked, task_type, ["/nowhere"])
    assert {r.requested: r.status for r in found.collect()} == {"app": "unresolved", "Row": "resolved"}
    row = strict.first()
    assert [a.name for a in row.assembly.anchors] == ["Row"] and not row.fallback and "const App = 1" in row.context
    hard, found = retrieval.graph_contexts(small, corpus, asked, task_type, ["/nowhere"], hardened=True)
    row = hard.first()
    assert [a.name for a in row.assembly.anchors] == ["App", "Row"] and {r.status for r in found.collect()} == {"exact", "case_insensitive"}
    if task_type == "feature_addition":
        assert any("'/nowhere'" in n for n in row.assembly.kept_notes) and "Project routing table:" in row.assembly.kept_notes
    if task_type == "refactoring":
        assert any("(props: label, onClick)" in n for n in row.assembly.kept_notes)
    lost, _ = retrieval.graph_contexts(small, corpus, spark.createDataFrame([(1, "p", "Zebra")], "request_id int, project_id string, requested string"), task_type, hardened=True)
    row = lost.first()
    assert row.fallback and [n.name for n in row.assembly.neighbours] == ["App", "Row"] and "project-wide overview" in row.context


def test_overviews_are_cut_by_project(spark, small):
    """The limit holds in each project, so a project of small components beside one of large ones gets its own."""
    two = graph.Graph(*[df.unionByName(df.withColumn("project_id", F.lit("q"))) for df in (small.nodes, small.edges)])
    top = templates.project_overview(two, 1).collect()
    assert sorted((r.project_id, r.componentName) for r in top) == [("p", "App"), ("q", "App")]
    only = templates.project_overview(two, 1, projects=spark.createDataFrame([("q",)], "project_id string")).collect()
    assert [r.project_id for r in only] == ["q"]


def test_budgets_and_recall(spark):
    tasks = spark.createDataFrame([("P1",), ("P2",)], "task_id string")
    runs = spark.createDataFrame([("P1", 5), ("P1", 5), ("P2", 7)], "task_id string, tokens bigint")
    assert {r.task_id: r.budget for r in retrieval.with_budgets(tasks, retrieval.matched_budgets(runs)).collect()} == {"P1": 5, "P2": 7}
    with pytest.raises(Exception, match="no budget"):
        retrieval.with_budgets(tasks, retrieval.matched_budgets(runs.where("task_id = 'P1'"))).collect()
    got = retrieval.recall(spark.createDataFrame([("P1", "bm25", ["a", "b"])], "task_id string, retriever string, files array<string>"), spark.createDataFrame([("P1", ["a", "c"])], "task_id string, targets array<string>"), "retriever").first()
    assert (got.kept, got.wanted) == (1, 2)
    assert retrieval.throttle({"requests": 100, "tokens": 10_000}, {"requests": 1, "tokens": 1000})["delay_s"] == pytest.approx(7.5)
