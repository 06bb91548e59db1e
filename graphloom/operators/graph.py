"""Property-graph primitives: keyed upserts, endpoint joins and branches that are aggregated before they meet their anchor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.schemas import COMPONENTS
from graphloom.sources.store import written


@dataclass(frozen=True)
class Graph:
    """Nodes and edges as declared in ``schemas.NODES`` and ``schemas.EDGES``."""

    nodes: DataFrame
    edges: DataFrame


def stored(graph: Graph) -> Graph:
    """The graph written by label and by relationship, so that a step over one kind of edge reads only that."""
    return Graph(written(graph.nodes, "label"), written(graph.edges, "rel"))


def label_counts(nodes: DataFrame) -> DataFrame:
    """Nodes by label; callers that show them order by n."""
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    """Edges by relationship; callers that show them order by n."""
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


def last_writer(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], once: Sequence[str] = ()) -> DataFrame:
    """One row a key: the last by ``order``; columns in ``once`` keep the first row's value, as properties set only on creation do.

    ``max_by`` combines before the shuffle, so a key that is written very often costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    last, first = F.max_by(F.struct(*rest), at).alias("_last"), F.min_by(F.struct(*rest), at).alias("_first")
    out = df.groupBy(*keys).agg(last, first)
    return out.select(*keys, *[F.col(f"{'_first' if c in once else '_last'}.{c}").alias(c) for c in rest]).select(*df.columns)


def first_writer(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_first")).select(*keys, "_first.*").select(*df.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], once: Sequence[str] = ()) -> DataFrame:
    """``table`` with ``changes`` written over it; a key's columns in ``once`` stay as they were created."""
    both = table.withColumn("_seq", F.lit(0)).unionByName(changes.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return last_writer(both, keys, ["_seq"], once).drop("_seq")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist; one with a missing end is dropped silently, as matching its ends would find nothing."""
    ids = nodes.select("project_id", "node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src_id"), ["project_id", "src_id"], "left_semi").join(
        ids.withColumnRenamed("node_id", "dst_id"), ["project_id", "dst_id"], "left_semi"
    )


def edges_from_uids(pairs: DataFrame, nodes: DataFrame, rel: str, src_labels: Sequence[str], dst_labels: Sequence[str]) -> DataFrame:
    """Edges for rows ``project_id, src_uid, dst_uid, props``: each end is the node with that uid under any of its labels."""
    by = lambda labels, uid, node: nodes.where(F.col("label").isin(*labels)).select("project_id", F.col("uid").alias(uid), F.col("node_id").alias(node))
    ends = pairs.join(by(src_labels, "src_uid", "src_id"), ["project_id", "src_uid"]).join(by(dst_labels, "dst_uid", "dst_id"), ["project_id", "dst_uid"])
    return ends.select("project_id", "src_id", "dst_id", F.lit(rel).alias("rel"), "props")


def in_project(graph: Graph, labels: Sequence[str], project_id: str | None = None) -> DataFrame:
    """Nodes of the labels that a file of the project defines (all projects if None)."""
    defined = graph.edges.where("rel = 'DEFINED_IN'").select("project_id", F.col("src_id").alias("node_id"), F.col("dst_id").alias("file_id"))
    owned = graph.edges.where("rel = 'BELONGS_TO'").select("project_id", F.col("src_id").alias("file_id"))
    found = graph.nodes.where(F.col("label").isin(*labels))
    if project_id is not None:
        found = found.where(F.col("project_id") == project_id)
    return found.join(defined.join(owned, ["project_id", "file_id"], "left_semi"), ["project_id", "node_id"], "left_semi")


def neighbours(graph: Graph, anchors: DataFrame, rels: Sequence[str], outgoing: bool = True, labels: Sequence[str] = ()) -> DataFrame:
    """``project_id, anchor_id, edge_props`` and the neighbour's columns, for each edge of the kinds at an anchor."""
    near, far = ("src_id", "dst_id") if outgoing else ("dst_id", "src_id")
    ids = anchors.select("project_id", F.col("node_id").alias("anchor_id"))
    steps = graph.edges.where(F.col("rel").isin(*rels)).select("project_id", F.col(near).alias("anchor_id"), F.col(far).alias("node_id"), F.col("props").alias("edge_props"))
    nodes = graph.nodes.where(F.col("label").isin(*labels)) if labels else graph.nodes
    return steps.join(ids, ["project_id", "anchor_id"], "left_semi").join(nodes, ["project_id", "node_id"])


def collected(found: DataFrame, name: str, fields: dict[str, Column], key: str | None = None) -> DataFrame:
    """``project_id, anchor_id, name``: the distinct structs of ``fields`` in order; those whose ``key`` is null are no entries."""
    entry = F.struct(*[c.alias(k) for k, c in fields.items()])
    if key:
        found = found.where(fields[key].isNotNull())
    return found.groupBy("project_id", "anchor_id").agg(F.sort_array(F.collect_set(entry)).alias(name))


@dataclass(frozen=True)
class Branch:
    """An optional branch: the distinct entries (``fields`` of the node at the far end, of the edge's ``edge_props``, or ``defined_in``) along the
    edges of ``rels``; entries whose ``key`` is null are none."""

    name: str
    rels: tuple[str, ...]
    fields: dict[str, Column]
    outgoing: bool = True
    labels: tuple[str, ...] = ()
    key: str = "name"


def defining_files(graph: Graph) -> DataFrame:
    """``project_id, node_id, defined_in``: the path of the file that defines a node."""
    at = graph.edges.where("rel = 'DEFINED_IN'").select("project_id", F.col("src_id").alias("node_id"), F.col("dst_id").alias("_file"))
    files = graph.nodes.where("label = 'File'").select("project_id", F.col("node_id").alias("_file"), F.col("file_path").alias("defined_in"))
    return at.join(files, ["project_id", "_file"]).drop("_file")


def with_branches(graph: Graph, anchors: DataFrame, branches: Sequence[Branch], more: Sequence[DataFrame] = (), files: bool = False) -> DataFrame:
    """Anchors (``node_id`` as ``anchor_id``) with each branch's array, empty where a branch has nothing.

    All branches are found in one pass: one filter of the edges, one join to the nodes, one aggregation by anchor with a conditional set a branch. So
    branches never multiply, and a template shuffles once however many it has. ``more``: frames from ``collected``. ``files``: whether entries use ``defined_in``."""
    parts = []
    for outgoing, near, far in ((True, "src_id", "dst_id"), (False, "dst_id", "src_id")):
        rels = sorted({r for b in branches if b.outgoing == outgoing for r in b.rels})
        if rels:
            edges = graph.edges.where(F.col("rel").isin(*rels))
            parts.append(edges.select("project_id", F.col(near).alias("anchor_id"), F.col(far).alias("node_id"), "rel", F.lit(outgoing).alias("_out"), F.col("props").alias("edge_props")))
    steps = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ids = anchors.select("project_id", F.col("node_id").alias("anchor_id"))
    found = steps.join(ids, ["project_id", "anchor_id"], "left_semi").join(graph.nodes, ["project_id", "node_id"])
    if files:
        found = found.join(defining_files(graph), ["project_id", "node_id"], "left")

    def entries(b: Branch) -> Column:
        belongs = F.col("rel").isin(*b.rels) & (F.col("_out") == b.outgoing) & b.fields[b.key].isNotNull()
        if b.labels:
            belongs &= F.col("label").isin(*b.labels)
        return F.sort_array(F.collect_set(F.when(belongs, F.struct(*[c.alias(k) for k, c in b.fields.items()])))).alias(b.name)

    out = anchors.withColumnRenamed("node_id", "anchor_id")
    for frame in (found.groupBy("project_id", "anchor_id").agg(*map(entries, branches)), *more):
        out = out.join(frame, ["project_id", "anchor_id"], "left")
        for name in frame.columns[2:]:
            out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast(frame.schema[name].dataType)))
    return out


def set_root(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``isRoot`` of components: true for those named in ``roots`` (``project_id, name``), false for all others."""
    marks = roots.select("project_id", "name").distinct().withColumn("_root", F.lit(True))
    component = F.col("label").isin(*COMPONENTS)
    flagged = F.map_concat(F.map_filter("props", lambda k, _: k != "isRoot"), F.create_map(F.lit("isRoot"), F.coalesce("_root", F.lit(False)).cast("string")))
    return nodes.join(marks, ["project_id", "name"], "left").withColumn("props", F.when(component, flagged).otherwise(F.col("props"))).select(nodes.columns)


def drop_project(graph: Graph, project_id: str) -> Graph:
    """The graph without a project's nodes and edges."""
    keep = F.col("project_id") != project_id
    return Graph(graph.nodes.where(keep), graph.edges.where(keep))


def files_of(graph: Graph) -> DataFrame:
    """Paths of all file nodes in order."""
    return graph.nodes.where("label = 'File'").select("project_id", "file_path").orderBy("project_id", "file_path")
