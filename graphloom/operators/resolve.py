"""Resolution ladders: every candidate gets its rung and its place on the rung, and the least of a request wins."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions import paths
from graphloom.functions.udf import series_udf
from graphloom.schemas import ANCHORS

FUZZY_CUTOFF = 0.80
PATH_TOKEN = r"[\w./-]*[\w-]+\.(?:tsx?|jsx?)|[\w-]+/[\w./-]+"


def first_hit(hits: DataFrame, request: str = "request_id", order=("rung", "place")) -> DataFrame:
    """One row a request: that of the least rung and place."""
    rest = [c for c in hits.columns if c != request]
    return hits.groupBy(request).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_hit")).select(request, "_hit.*")


def import_bases(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """``requests`` (``project_id, specifier, current_file``) with ``base``, by each project's ``aliases`` (a map) and ``base_url``."""
    known = requests.join(projects.select("project_id", "aliases", "base_url"), "project_id", "left")
    none = F.create_map().cast("map<string,string>")
    return known.withColumn("base", paths.import_base(F.col("specifier"), F.col("current_file"), F.coalesce("aliases", none), F.col("base_url"))).drop("aliases", "base_url")


def manifest_files(requests: DataFrame, projects: DataFrame, manifest: DataFrame) -> DataFrame:
    """``request_id, file_path``: the file each import means. Requests: ``request_id, project_id, specifier, current_file, symbol``; manifest: ``project_id, file_path``."""
    tried = import_bases(requests, projects).select("request_id", "project_id", F.posexplode(F.when(F.col("symbol").isNull(), paths.candidates(F.col("base"))).otherwise(paths.candidates(F.col("base"), F.col("symbol")))).alias("place", "file_path"))
    found = tried.where("file_path is not null").join(manifest.select("project_id", "file_path").distinct(), ["project_id", "file_path"])
    return first_hit(found.withColumn("rung", F.lit(0)).select("request_id", "rung", "place", "file_path")).select("request_id", "file_path")


def _by_uid(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Rungs 0 (same file) and 1 (a candidate file), through the uid ``name::file``."""
    same = requests.where("specifier = 'same_file'").select("request_id", "project_id", F.lit(0).alias("rung"), F.lit(0).alias("place"), F.concat("name", F.lit("::"), "current_file").alias("uid"))
    tried = requests.where("specifier != 'same_file' and base is not null").select("request_id", "project_id", "name", F.posexplode(paths.candidates(F.col("base"))).alias("place", "file"))
    named = tried.select("request_id", "project_id", F.lit(1).alias("rung"), "place", F.concat("name", F.lit("::"), "file").alias("uid"))
    return same.unionByName(named).join(index.select("project_id", "uid", "node_id"), ["project_id", "uid"]).select("request_id", "rung", "place", "uid", "node_id")


def _under_directory(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Rung 2: a node of that name in a file directly below the import's directory, or in an index file of a folder named after it. Among several,
    label order, then uid decides."""
    asked = requests.where("specifier != 'same_file' and base is not null").select("request_id", "project_id", "name", F.regexp_replace("base", "/+$", "").alias("directory"))
    near = asked.join(index, ["project_id", "name"])
    rest = F.substring(F.col("file_path"), F.length("directory") + 2, F.length("file_path"))
    folder = F.array(*[F.concat(F.col("name"), F.lit(f"/index{e}")) for e in paths.EXTENSIONS])
    fits = F.col("file_path").startswith(F.concat("directory", F.lit("/"))) & (~rest.contains("/") | F.array_contains(folder, rest))
    return near.where(fits).select("request_id", F.lit(2).alias("rung"), F.struct("label_rank", "uid").alias("_at"), "uid", "node_id")


#: What decides which node a request means; requests that agree in it are asked once.
ASK = ("project_id", "name", "specifier", "current_file")


def _asked(requests: DataFrame) -> DataFrame:
    """The different questions, each its own ``request_id``."""
    return requests.select(*ASK).distinct().select(F.struct(*ASK).alias("request_id"), *ASK)


def children(requests: DataFrame, projects: DataFrame, nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """``project_id, name, specifier, current_file, uid, node_id, rung`` of the component each different request means: same file, a candidate file, the import's
    directory, the only component of the file it lands on, or that file's only default export. Unresolved requests have no row.

    Requests: ``project_id, name, specifier, current_file``."""
    requests = _asked(requests)
    rank = F.array_position(F.array(*map(F.lit, ANCHORS)), F.col("label")).cast("int")
    index = nodes.where(F.col("label").isin(*ANCHORS)).select("project_id", "node_id", "uid", "name", "file_path", "label", F.col("props")["exportType"].alias("export"), rank.alias("label_rank"))
    based = import_bases(requests, projects)
    at = lambda df: df.withColumn("_at", F.struct(F.col("place").alias("label_rank"), F.lit("").alias("uid"))).drop("place")
    asked = requests.where("specifier != 'same_file'").select("request_id", "project_id", "specifier", "current_file").withColumn("symbol", F.lit(None).cast("string"))
    landed = asked.select("request_id", "project_id").join(manifest_files(asked, projects, manifest), "request_id")
    # By file before the join: a file may hold as many components as there are requests for it.
    counted = index.where("label != 'Custom_Hook'").groupBy("project_id", "file_path").agg(
        F.count("*").alias("n"), F.count_if(F.col("export") == "default").alias("defaults"),
        F.first(F.struct("uid", "node_id")).alias("any"), F.first(F.when(F.col("export") == "default", F.struct("uid", "node_id")), ignorenulls=True).alias("default"),
    )
    sole = landed.join(counted.where("n = 1 or defaults = 1"), ["project_id", "file_path"]).select("request_id", F.when(F.col("n") == 1, 3).otherwise(4).alias("rung"), F.when(F.col("n") == 1, F.col("any")).otherwise(F.col("default")).alias("hit"))
    sole = sole.select("request_id", "rung", F.struct(F.lit(0).alias("label_rank"), F.lit("").alias("uid")).alias("_at"), "hit.uid", "hit.node_id")
    hits = at(_by_uid(based, index)).select("request_id", "rung", "_at", "uid", "node_id").unionByName(_under_directory(based, index)).unionByName(sole)
    return first_hit(hits, order=("rung", "_at")).select("request_id.*", "uid", "node_id", "rung")


def contexts(requests: DataFrame, projects: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``children`` for context nodes, over the first three rungs."""
    index = nodes.where("label = 'Context'").select("project_id", "node_id", "uid", "name", "file_path", F.lit(1).alias("label_rank"))
    based = import_bases(_asked(requests), projects)
    by_uid = _by_uid(based, index).withColumn("_at", F.struct(F.col("place").alias("label_rank"), F.lit("").alias("uid"))).select("request_id", "rung", "_at", "uid", "node_id")
    return first_hit(by_uid.unionByName(_under_directory(based, index)), order=("rung", "_at")).select("request_id.*", "uid", "node_id", "rung")


def longest_prefix(df: DataFrame, value: str, prefixes: DataFrame, boundary: str = "/") -> DataFrame:
    """``df`` with the ``target`` of the longest prefix that equals the value or ends at a boundary in it; null where none does.

    Each different value is cut at its boundaries and the pieces are joined by equality, so no row meets every prefix. Prefixes: ``prefix, target``."""
    parts = F.split(F.col(value), boundary)
    heads = df.select(value).where(F.col(value).isNotNull()).distinct()
    heads = heads.select(value, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), boundary))).alias("prefix"))
    best = heads.join(prefixes, "prefix").groupBy(value).agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("_best"))
    return df.join(best, value, "left").select(*df.columns, F.col("_best.prefix").alias("prefix"), F.col("_best.target").alias("target"))


def category(df: DataFrame, name: str, exact: dict[str, str], prefixes: dict[str, str], other: str = "other") -> Column:
    """A category column: the exact entry, else the first prefix in order, else ``other``. Both tables are short literals."""
    table = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
    ladder = F.coalesce(table[F.col(name)], *[F.when(F.col(name).startswith(p), F.lit(c)) for p, c in prefixes.items()], F.lit(other))
    return ladder


def path_hints(spec: Column) -> Column:
    """Path segments that a text names, with and without their extension."""
    found = F.regexp_extract_all(F.coalesce(spec, F.lit("")), F.lit(f"(?U){PATH_TOKEN}"), F.lit(0))
    parts = F.flatten(F.transform(found, lambda t: F.split(F.translate(t, "\\", "/"), "/")))
    bare = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[.,;:`'\"()\[\]]+|[.,;:`'\"()\[\]]+$", "")), lambda p: p != "")
    return F.array_distinct(F.filter(F.concat(bare, F.transform(bare, lambda p: F.regexp_replace(p, r"\.[^.]*$", ""))), lambda p: p != ""))


def path_overlap(file_path: Column, hints: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(file_path, F.lit("")), "/"), lambda p: p != "")
    return F.size(F.array_intersect(F.array_union(parts, F.transform(parts, lambda p: F.regexp_replace(p, r"\.[^.]*$", ""))), hints))


@series_udf("struct<name:string,score:double>")
def _closest(requested: pd.Series, names: pd.Series) -> pd.DataFrame:
    out = []
    for one, known in zip(requested, names, strict=True):
        near = difflib.get_close_matches(one, sorted(set(known)), n=3, cutoff=FUZZY_CUTOFF) if known is not None else []
        out.append((near[0], round(difflib.SequenceMatcher(None, one, near[0]).ratio(), 3)) if near else (None, None))
    return pd.DataFrame(out, columns=["name", "score"])


def resolve_anchors(requests: DataFrame, nodes: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Each request with ``status, matched_by, name, uid, file_path, score, alternatives``.

    Requests: ``request_id, project_id, requested`` and optionally ``spec``; nodes: anchor candidates. Exact names, then names that differ in case,
    then the closest spelling; ``ambiguous`` if the rung has several nodes, the one whose path the spec names most of comes first, then the least uid."""
    if "spec" not in requests.columns:
        requests = requests.withColumn("spec", F.lit(""))
    pool = nodes.select("project_id", F.col("name").alias("node_name"), "uid", "file_path")
    asked = requests.select("request_id", "project_id", "requested", "spec")
    exact = asked.join(pool, (asked["project_id"] == pool["project_id"]) & (asked["requested"] == pool["node_name"])).select("request_id", F.lit(0).alias("rung"), "node_name", "uid", "file_path", F.lit(None).cast("double").alias("score"), "spec")
    left = asked.join(exact, "request_id", "left_anti")
    folded = left.join(pool, (left["project_id"] == pool["project_id"]) & (F.lower(left["requested"]) == F.lower(pool["node_name"])))
    folded = folded.select("request_id", F.lit(1).alias("rung"), "node_name", "uid", "file_path", F.lit(None).cast("double").alias("score"), "spec")
    hits = exact.unionByName(folded)
    if fuzzy:
        rest = left.join(folded, "request_id", "left_anti")
        known = pool.groupBy("project_id").agg(F.sort_array(F.collect_set("node_name")).alias("names"))
        close = rest.join(known, "project_id").withColumn("close", _closest("requested", "names")).where("close.name is not null").select("request_id", "project_id", "spec", F.col("close.name").alias("node_name"), "close.score")
        hits = hits.unionByName(close.join(pool, ["project_id", "node_name"]).select("request_id", F.lit(2).alias("rung"), "node_name", "uid", "file_path", "score", "spec"))
    order = F.struct((-path_overlap(F.col("file_path"), path_hints(F.col("spec")))).alias("overlap"), F.coalesce("uid", F.lit("")).alias("uid"), F.col("node_name").alias("name"), "file_path", "score", "rung")
    ranked = hits.groupBy("request_id").agg(F.sort_array(F.collect_list(order)).alias("ranked"))
    best = F.element_at("ranked", 1)
    rung = F.element_at(F.array(*map(F.lit, ("exact", "case_insensitive", "fuzzy"))), best["rung"] + 1)
    named = ranked.select(
        "request_id", F.size("ranked").alias("n"), rung.alias("matched_by"), best["name"].alias("name"), best["uid"].alias("uid"), best["file_path"].alias("file_path"), best["score"].alias("score"),
        F.transform(F.slice("ranked", 2, F.greatest(F.size("ranked") - 1, F.lit(0))), lambda x: x["uid"]).alias("alternatives"),
    )
    none = F.array().cast("array<string>")
    return requests.drop("spec").join(named, "request_id", "left").select(
        *[c for c in requests.columns if c != "spec"],
        F.when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.coalesce("matched_by", F.lit("unresolved"))).alias("status"),
        F.coalesce("matched_by", F.lit("none")).alias("matched_by"), "name", "uid", "file_path", "score", F.coalesce("alternatives", none).alias("alternatives"),
    )


def resolve_strictly(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exact names only: ``resolved``, ``ambiguous`` or ``unresolved`` by how many nodes have the name."""
    counts = nodes.groupBy("project_id", F.col("name").alias("requested")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return requests.join(counts, ["project_id", "requested"], "left").withColumn("status", status).drop("n")


def known_routes(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """``asked`` (``project_id, route``) with whether the project's table has the route."""
    table = routes.select("project_id", F.col("routePath").alias("route")).where("route is not null").distinct().withColumn("_known", F.lit(True))
    return asked.join(table, ["project_id", "route"], "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def contained_specs(records: DataFrame, specs: DataFrame, text: str, spec: str, record_id: str, spec_id: str, words: int = 3) -> DataFrame:
    """``record_id, spec_id`` where the record's text contains the spec.

    Words inside a spec are whole words of any text that contains it. So specs of enough words meet texts on the run of ``words`` after their first word,
    by equality, and containment is tested on those pairs only. The few shorter specs are tested against every text."""
    run = lambda tokens, at: F.xxhash64(*[F.get(tokens, at + i) for i in range(words)])
    asked = specs.select(F.col(spec_id).alias("_sid"), F.col(spec).alias("_spec"), F.split(F.trim(F.col(spec)), r"\s+").alias("_t")).where("_spec is not null and _spec != ''")
    rows = records.select(F.col(record_id).alias("_rid"), F.col(text).alias("_text")).where("_text is not null")
    long = asked.where(F.size("_t") >= words + 2).withColumn("_key", run(F.col("_t"), F.lit(1)))
    tokens = rows.select("_rid", F.split("_text", r"\s+").alias("_t")).where(F.size("_t") >= words + 2)
    keys = F.transform(F.sequence(F.lit(0), F.size("_t") - words), lambda i: run(F.col("_t"), i))
    heads = tokens.select("_rid", F.explode(F.array_distinct(keys)).alias("_key")).join(long.select("_key").distinct(), "_key", "left_semi")
    pairs = heads.join(long.select("_key", "_sid"), "_key").select("_rid", "_sid").distinct()
    hits = pairs.join(rows, "_rid").join(long.select("_sid", "_spec"), "_sid").where(F.contains("_text", "_spec")).select("_rid", "_sid")
    short = rows.join(asked.where(F.size("_t") < words + 2), F.contains("_text", "_spec")).select("_rid", "_sid")
    return hits.unionByName(short).select(F.col("_rid").alias(record_id), F.col("_sid").alias(spec_id))
