"""Line-oriented graph dumps, read into and written from node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.operators.graph import Graph

# The two statements of a dump, and a property in them.
NODE = r"^CREATE \(:__mg_vertex__:`(\w+)` \{__mg_id__: (\d+)(.*)\}\);$"
EDGE = r"^MATCH \(u:__mg_vertex__\), \(v:__mg_vertex__\) WHERE u\.__mg_id__ = (\d+) AND v\.__mg_id__ = (\d+) CREATE \(u\)-\[:`(\w+)`(?: \{(.*)\})?\]->\(v\);$"
PROPERTY = r'`(\w+)`: ("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|true|false|null|\[[^\]]*\])'


def properties(text: Column) -> Column:
    """A statement's properties as a map of strings: escapes undone, numbers, truth values and lists as written, nulls as null."""
    names, raw = F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(1)), F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(2))
    plain = F.transform(raw, lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.replace(v, F.lit("\\'"), F.lit("'")), F.lit("}")), "$.v")).when(v != "null", v))
    return F.map_from_arrays(names, plain)


def lines(spark: SparkSession, path: str, project: Column | str | None = None) -> DataFrame:
    """``project_id, value``: the lines of a dump; the project is the folder it lies in unless named."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    name = folder if project is None else F.lit(project) if isinstance(project, str) else project
    return spark.read.text(path).select(name.alias("project_id"), F.rtrim("value").alias("value"))


def nodes(text: DataFrame) -> DataFrame:
    found = text.where(F.col("value").rlike(NODE)).select("project_id", *[F.regexp_extract("value", NODE, i).alias(n) for i, n in ((1, "label"), (2, "_id"), (3, "_props"))])
    found = found.select("project_id", F.col("_id").cast("bigint").alias("node_id"), "label", properties(F.col("_props")).alias("props"))
    p = F.col("props")
    uid = F.coalesce(p["uid"], F.when(F.col("label") == "File", p["filePath"]).when(F.col("label") == "Project", p["projectId"]).otherwise(p["name"]))
    return found.select("project_id", "node_id", "label", uid.alias("uid"), p["name"].alias("name"), p["filePath"].alias("file_path"), "props")


def edges(text: DataFrame) -> DataFrame:
    found = text.where(F.col("value").rlike(EDGE)).select("project_id", *[F.regexp_extract("value", EDGE, i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "rel"), (4, "_props"))])
    return found.select("project_id", F.col("a").cast("bigint").alias("src_id"), F.col("b").cast("bigint").alias("dst_id"), "rel", properties(F.col("_props")).alias("props"))


def read(spark: SparkSession, path: str, project: str | None = None) -> Graph:
    """The graph of one or several dumps. Statements of any other shape are passed over."""
    text = lines(spark, path, project)
    return Graph(nodes(text), edges(text))


def read_anchors(spark: SparkSession, path: str, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Only what resolution needs: anchors' names and places, and the paths of routes."""
    graph = read(spark, path, project)
    anchors = graph.nodes.where(F.col("label").isin("Function_Component", "Class_Component", "Custom_Hook")).select("project_id", "name", "uid", "file_path", "label")
    routes = graph.edges.where("rel = 'ROUTES_TO'").select("project_id", F.col("props")["path"].alias("routePath")).where("routePath is not null").distinct()
    return anchors, routes


def statement_counts(text: DataFrame) -> DataFrame:
    """Statements read, passed over, and comments or blank lines, by project."""
    v = F.trim("value")
    kind = F.when(v.rlike(NODE) | v.rlike(EDGE), "read").when((v == "") | v.startswith("//"), "blank").otherwise("passed_over")
    return text.groupBy("project_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def _literal(value: Column) -> Column:
    bare = value.rlike(r"^(-?\d+(\.\d+)?|true|false|\[.*\])$")
    text = F.regexp_replace(F.regexp_replace(value, r"([\\\"])", r"\\$1"), "\n", r"\\n")
    return F.when(value.isNull(), "null").when(bare, value).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _map(props: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.map_keys(props)), lambda k: F.concat(F.lit("`"), k, F.lit("`: "), _literal(props[k]))), ", ")


def statements(graph: Graph) -> DataFrame:
    """``project_id, value``: a graph as statements, nodes before edges within a project when sorted by ``step``."""
    own = _map(F.col("props"))
    n = graph.nodes.select("project_id", F.lit(0).alias("step"), F.concat(F.lit("CREATE (:__mg_vertex__:`"), "label", F.lit("` {__mg_id__: "), F.abs("node_id").cast("string"), F.when(own != "", F.concat(F.lit(", "), own)).otherwise(F.lit("")), F.lit("});")).alias("value"))
    e = graph.edges.select(
        "project_id", F.lit(1).alias("step"),
        F.concat(F.lit("MATCH (u:__mg_vertex__), (v:__mg_vertex__) WHERE u.__mg_id__ = "), F.abs("src_id").cast("string"), F.lit(" AND v.__mg_id__ = "), F.abs("dst_id").cast("string"), F.lit(" CREATE (u)-[:`"), "rel", F.lit("`"), F.when(own != "", F.concat(F.lit(" {"), own, F.lit("}"))).otherwise(F.lit("")), F.lit("]->(v);")).alias("value"),
    )
    return n.unionByName(e)


def write(graph: Graph, path: str) -> None:
    """Dumps by project folder, nodes first."""
    statements(graph).repartition("project_id").sortWithinPartitions("project_id", "step").select("project_id", "value").write.mode("overwrite").partitionBy("project_id").text(path)
