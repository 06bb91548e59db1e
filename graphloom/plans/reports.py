"""The fixture tables bound to text and path functions, logs, edit scripts, annotations, gates and retrieval figures."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions import paths, text
from graphloom.operators import context, cost, edits, evaluation, progress, resolve, retrieval, templates
from graphloom.plans import binding
from graphloom.plans.binding import CALLS_SQL, GRAPH_SQL, RESULTS_SQL, table
from graphloom.plans.registry import INTERFACE_LABELS, INTERFACE_RELS, components_only, query, rounded
from graphloom.sources import files, logs
from graphloom.sources.store import shared_folder, written


def folder(spark: SparkSession, name: str) -> str:
    """A new folder among the shared ones."""
    return os.path.join(shared_folder(spark), f"graphloom-{name}-{uuid.uuid4().hex}")


def cases(*values: Column | str | None, by: str = "doc_id") -> Column:
    """A value by the id's remainder."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(F.col(by) % len(values) == i, F.lit(v) if v is None or isinstance(v, str) else v)
    return out


# Texts and paths


@query("""WITH d AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'use' || upper(lang) WHEN 1 THEN 'use' || lang WHEN 2 THEN lang ELSE 'reuseX' END AS name,
    CASE doc_id % 8 WHEN 0 THEN '12' WHEN 1 THEN '-1.5' WHEN 2 THEN '''a''' WHEN 3 THEN 'f(x)' WHEN 4 THEN ' true ' WHEN 5 THEN '[]' WHEN 6 THEN '' ELSE '{}' END AS value,
    CASE doc_id % 3 WHEN 0 THEN 'claude-' || lang WHEN 1 THEN source || '/' || lang ELSE lang END AS model, '/' || source || ' ' || lang || '.x' AS place FROM documents)
  SELECT doc_id, regexp_matches(name, '^use[A-Z]') AS hook, doc_id % 8 NOT IN (3, 6) AS literal, CASE WHEN doc_id % 2 = 0 THEN lang || '_x' END AS cause,
    CASE doc_id % 3 WHEN 1 THEN source ELSE 'anthropic' END AS provider, 'c_' || regexp_replace(place, '[^a-zA-Z0-9_.-]', '_', 'g') AS container, 'a|' || lang AS tests, source || '/a.md,' || lang || '.md' AS shown,
    round_even(n_chars / 4, 0) AS even, substr(sha256(coalesce(text, '')), 1, 12) AS id12, substr(sha256(coalesce(text, '')), 1, 16) || '::p::' || model AS cache_key, replace(place, '/', '_') AS flat FROM d""")
def text_forms(spark, sf):
    lang, source = F.col("lang"), F.col("source")
    d = table(spark, sf, "documents").withColumns({
        "name": cases(F.concat(F.lit("use"), F.upper(lang)), F.concat(F.lit("use"), lang), lang, "reuseX"), "value": cases("12", "-1.5", "'a'", "f(x)", " true ", "[]", "", "{}"),
        "model": cases(F.concat(F.lit("claude-"), lang), F.concat_ws("/", source, lang), lang), "place": F.concat(F.lit("/"), source, F.lit(" "), lang, F.lit(".x")),
    })
    note = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("seen. Cause: "), lang, F.lit("_X 1"))).otherwise(source)
    prompt = F.concat(F.lit("## no\n#### A (`"), source, F.lit("/a.md`)\nbody\n#### B c (`"), lang, F.lit(".md`)\n#### A (`"), source, F.lit("/a.md`)"))
    body = F.coalesce("text", F.lit(""))
    return d.select(
        "doc_id", text.is_hook_name(F.col("name")).alias("hook"), text.is_literal(F.col("value")).alias("literal"), text.cause_tag(note).alias("cause"), text.model_provider(F.col("model")).alias("provider"),
        text.container_name(F.col("place")).alias("container"), text.test_pattern(F.array(F.concat(source, F.lit("/a.test.js")), F.concat(lang, F.lit(".test.tsx")))).alias("tests"), F.array_join(text.shown_files(prompt), ",").alias("shown"),
        text.half_even(F.col("n_chars") / 4).alias("even"), text.short_hash(body, 12).alias("id12"), text.cache_key(body, F.lit("p"), F.col("model")).alias("cache_key"), paths.flattened(F.col("place")).alias("flat"),
    )


@query("""WITH d AS (SELECT doc_id, lang, source, CASE doc_id % 6 WHEN 0 THEN 'src/' || source || '/' || lang WHEN 1 THEN 'src/' || lang WHEN 2 THEN 'src/alias/' || lang WHEN 3 THEN 'base/comp/' || lang WHEN 4 THEN 'deep/' || lang END AS base FROM documents)
  SELECT doc_id, base, base || '.jsx' AS first, base || '/Sym.jsx' AS own, base || '/index.ts' AS last, CASE WHEN base IS NULL THEN 1 ELSE 8 END AS tried,
    doc_id % 6 = 1 AS escapes, CASE doc_id % 6 WHEN 0 THEN 'src/' || source ELSE 'src/' || source || '/in' END AS parent FROM d""")
def path_forms(spark, sf):
    """Import specifiers of six kinds: relative, one up, an alias, the base, a longer alias, and a package that is none of the project's."""
    lang = F.col("lang")
    ends = lambda head: F.concat(F.lit(head), lang)
    d = table(spark, sf, "documents").withColumn("spec", cases(ends("./x/../"), ends(".././../"), ends("@a/"), ends("comp/"), ends("@a/b/"), ends("@other/")))
    inner = F.concat(F.lit("src/"), F.col("source"), F.when(F.col("doc_id") % 6 == 0, "").otherwise("/in"), F.lit("/file.ts"))
    aliases = F.create_map(F.lit("@a"), F.lit("src/alias"), F.lit("@a/b"), F.lit("deep"))
    base = paths.import_base(F.col("spec"), inner, aliases, F.lit("base"))
    tried = paths.candidates(base)
    out_of = F.concat(F.when(F.col("doc_id") % 6 == 1, "a/../../").otherwise("a/../"), lang)
    return d.select(
        "doc_id", base.alias("base"), F.element_at(tried, 1).alias("first"), F.element_at(paths.candidates(base, F.lit("Sym")), 1).alias("own"), F.element_at(tried, -1).alias("last"),
        F.when(base.isNull(), 1).otherwise(F.size(tried)).alias("tried"), paths.escapes(out_of).alias("escapes"), paths.parent(inner).alias("parent"),
    )


@query("""SELECT doc_id, lang || '.md' AS named, CAST(CASE doc_id % 2 WHEN 0 THEN 3 ELSE 1 END AS INTEGER) AS overlap FROM documents""")
def path_hint_overlap(spark, sf):
    d = table(spark, sf, "documents").withColumn("spec", F.concat(F.lit("Please fix `src/"), "source", F.lit("/"), "lang", F.lit(".tsx`, now.")))
    file = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit(".jsx"))).otherwise(F.concat(F.lit("lib/"), "lang", F.lit(".ts")))
    return d.select("doc_id", F.concat("lang", F.lit(".md")).alias("named"), resolve.path_overlap(file, resolve.path_hints(F.col("spec"))).alias("overlap"))


@query("""SELECT page_id, regexp_matches(name, '[^.]\\.(js|jsx|ts|tsx)$') AND NOT regexp_matches(name, '\\.(test|spec)\\.') AND page_id % 5 <> 0 AND NOT page_id % 7 = 0 AS kept
  FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a.js' WHEN 1 THEN 'a.test.tsx' WHEN 2 THEN 'b.tsx' ELSE 'c.css' END AS name FROM pages)""")
def source_files(spark, sf):
    """Paths with names, folders and prefixes that count or don't."""
    name = cases("a.js", "a.test.tsx", "b.tsx", "c.css", by="page_id")
    path = F.concat(F.when(F.col("page_id") % 5 == 0, "src/node_modules/").when(F.col("page_id") % 7 == 0, "old/").otherwise("src/"), name)
    return table(spark, sf, "pages").select("page_id", files.is_source(path, ["old"]).alias("kept"))


# Anchors


@query(f"""WITH {GRAPH_SQL}, r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'one' ELSE 'none' END AS requested FROM documents)
  SELECT doc_id AS request_id, CASE requested WHEN 'same' THEN 'ambiguous' WHEN 'one' THEN 'resolved' ELSE 'unresolved' END AS status FROM r""")
def anchor_resolve_strict(spark, sf):
    nodes = spark.createDataFrame([("p", "same", "same::a"), ("p", "same", "same::b"), ("p", "one", "one::a"), ("q", "none", "none::a")], "project_id string, name string, uid string")
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), F.lit("p").alias("project_id"), cases("same", "one", "none").alias("requested"))
    return resolve.resolve_strictly(asked, nodes).select("request_id", "status")


@query(f"""WITH {GRAPH_SQL}, t AS (SELECT DISTINCT project_id, '/' || export AS route FROM routed), a AS (SELECT DISTINCT project_id, '/' || export || CASE WHEN export = 'BUILDING' THEN 'X' ELSE '' END AS route FROM cust)
  SELECT a.project_id, a.route, t.route IS NOT NULL AS known FROM a LEFT JOIN t USING (project_id, route)""")
def known_routes(spark, sf):
    g = binding.graph(spark, sf, ["File", "Function_Component", "Class_Component"], ["BELONGS_TO", "DEFINED_IN", "ROUTES_TO"])
    export = F.col("props")["exportType"]
    asked = g.nodes.where("label = 'Function_Component'").select("project_id", F.concat(F.lit("/"), export, F.when(export == "BUILDING", "X").otherwise("")).alias("route")).distinct()
    return resolve.known_routes(asked, templates.routing_table(g))


# Logs


@query(f"""WITH {CALLS_SQL} SELECT run_id, call_purpose, model_id, provider AS openrouter_provider, count(*) AS calls, count(*) FILTER (model_id = 'error') AS errors FROM calls GROUP BY ALL""")
def call_log_counts(spark, sf):
    """The call log written as JSON lines in two runs and read back."""
    log = binding.calls(spark, sf)
    usage = F.struct("input_tokens", "output_tokens")
    error = F.when(F.col("model_id") == "error", F.struct(F.lit("e").alias("error_type"), F.lit("m").alias("message")))
    rows = log.select("timestamp", "run_id", "task_id", "condition_id", "model_id", F.col("provider").alias("openrouter_provider"), "call_purpose", usage.alias("usage"), error.alias("error"))
    at = folder(spark, "calls")
    rows.where("run_id < 'run2'").write.json(f"{at}/a")
    rows.where("run_id >= 'run2'").write.json(f"{at}/b")
    read = logs.calls(spark, f"{at}/*").unionByName(logs.calls(spark, f"{at}/none"))
    return read.groupBy("run_id", "call_purpose", "model_id", "openrouter_provider").agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'refactoring' WHEN 1 THEN 'feature_addition' ELSE 'bug_fix' END AS task_type, CASE WHEN doc_id % 5 < 3 THEN lang || ',B' ELSE '' END AS anchors, CASE doc_id % 5 WHEN 0 THEN '/' || source ELSE '' END AS routes FROM documents""")
def classifier_answers(spark, sf):
    """Fenced, bare, wrapped, wrong and unreadable answers."""
    names = F.concat(F.lit('"anchor_names": ["'), "lang", F.lit('", "B"]'))
    body = lambda kind, more="": F.concat(F.lit('{"task_type": "' + kind + '", '), names, *([F.lit(', "anchor_routes": ["/'), F.col("source"), F.lit('"]')] if more else []), F.lit("}"))
    answer = cases(F.concat(F.lit("```json\n"), body("refactoring", "r"), F.lit("\n```")), body("feature_addition"), F.concat(F.lit("I say "), body("new kind"), F.lit(" so")), "no json", "")
    a = logs.classifier_answer(answer)
    return table(spark, sf, "documents").select("doc_id", a["task_type"].alias("task_type"), F.array_join(a["anchor_names"], ",").alias("anchors"), F.array_join(a["anchor_routes"], ",").alias("routes"))


@query("""SELECT doc_id, lang AS kept, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'h' || lang ELSE 'n' || lang END AS provider, 'a' || chr(10) || lang AS prompt, CAST(2 + doc_id % 2 AS INTEGER) AS n_headers FROM documents""")
def call_headers(spark, sf):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    lang = F.col("lang")
    odd = F.when(F.col("doc_id") % 2 == 1, F.array(entry("X-More", "1"))).otherwise(F.array(entry("X-Empty", "")))
    served = F.array(entry("X-OpenRouter-Provider", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("h"), lang)).otherwise("")), entry("X-Provider-Name", F.when(F.col("doc_id") % 3 != 1, F.concat(F.lit("n"), lang)).otherwise("")))
    raw = F.map_from_entries(F.concat(F.array(entry("X-A", lang), entry("llm_provider-x-a", "other")), odd, served))
    message = lambda c: F.struct(F.lit("user").alias("role"), c.alias("content"))
    h = logs.headers(raw)
    return table(spark, sf, "documents").select(
        "doc_id", h["x-a"].alias("kept"), logs.provider(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(""), raw).alias("provider"),
        logs.prompt_text(F.array(message(F.lit("a")), message(lang))).alias("prompt"), F.size(h).alias("n_headers"),
    )


@query("""SELECT 'requests' AS resource, string_agg(DISTINCT l, ',' ORDER BY l) AS limits, min(rest) AS least_remaining FROM (SELECT CAST(100 + user_id % 2 AS VARCHAR) AS l, event_id % 50 AS rest FROM events)""")
def rate_limit_headroom(spark, sf):
    e = table(spark, sf, "events")
    limits = F.create_map(F.lit("Anthropic-RateLimit-Requests-Limit"), (100 + F.col("user_id") % 2).cast("string"), F.lit("anthropic-ratelimit-requests-remaining"), (F.col("event_id") % 50).cast("string"), F.lit("date"), F.lit("x"))
    return evaluation.rate_limits(e.select(limits.alias("rate_limit"))).select("resource", F.array_join("limits", ",").alias("limits"), "least_remaining")


@query("""SELECT 'k' || (vec_id % 100) AS key, arg_min(round(list_sum(embedding::DOUBLE[]), 3), vec_id) AS total, min(vec_id) AS first FROM embeddings GROUP BY 1""")
def embedding_cache(spark, sf):
    """Vectors as base64 of 32-bit floats in JSON lines; of several lines with one key the first counts."""
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("k"), (F.col("vec_id") % 100).cast("string")).alias("key"), F.col("embedding").cast("array<float>").alias("v"))
    at = folder(spark, "vectors")
    e.select("key", F.lit("file").alias("kind"), F.col("vec_id").cast("string").alias("label"), F.base64(logs.encode_vector("v")).alias("embedding_b64")).coalesce(1).sortWithinPartitions(F.col("label").cast("long")).write.json(at)
    found = logs.embeddings(spark, at)
    return found.select("key", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"), F.col("label").cast("bigint").alias("first"))


@query("""SELECT doc_id, lang || '/' || source AS first, CAST(2 AS INTEGER) AS n FROM documents""")
def markdown_tables(spark, sf):
    body = F.concat(F.lit("| no | table |\n|-|-|\n| x | y |\n\n## Here\nwords\n| a | b |\n|---|---|\n| "), "lang", F.lit(" | "), "source", F.lit(" |\n|c|d|\n\n| later | one |"))
    rows = logs.table_after(body, "## Here")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.element_at(rows, 1), "/").alias("first"), F.size(rows).alias("n"))


@query("""SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, '_' || n_name || '_' AS flat FROM nation""")
def csv_report(spark, sf):
    """A report written as CSV and read back by its heading."""
    at = folder(spark, "report")
    table(spark, sf, "nation").select("n_nationkey", "n_name", paths.flattened(F.concat(F.lit("/"), "n_name", F.lit("/"))).alias("flat")).write.option("header", True).csv(at)
    return logs.table(spark, at, "n_nationkey int, n_name string, flat string")


# Edit scripts


def _block(path: Column, search: Column, new: Column) -> Column:
    return F.concat(path, F.lit("\n<<<<<<< SEARCH\n"), search, F.lit("\n=======\n"), new, F.lit("\n>>>>>>> REPLACE\n"))


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidate_id, snapshot, edits, malformed_blocks, body``: documents as files of three lines, and answers with two edits that fit or don't."""
    body = F.concat_ws("\n", F.concat(F.lit("top "), "lang"), F.concat(F.lit("mid "), "source"), F.concat(F.lit("mid "), "source"), F.lit("end"))
    second = cases("end", "nowhere", F.concat(F.lit("mid "), "source"), None)
    path = F.lit("src/doc.txt")
    answer = F.concat(F.lit("Some words.\n"), _block(path, F.concat(F.lit("top "), "lang"), F.lit("first")), F.when(second.isNotNull(), _block(path, second, F.lit("second"))).otherwise(F.lit("<<<<<<< SEARCH\nx\n>>>>>>> REPLACE\n")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), F.col("doc_id").cast("string").alias("snapshot"), F.lit("search_replace").alias("format"), answer.alias("response"), body.alias("body"))
    return edits.parse_answers(d).select("candidate_id", "snapshot", "script.edits", "script.malformed_blocks", "body")


def sources_of(scripts: DataFrame) -> DataFrame:
    return scripts.select("snapshot", F.lit("src/doc.txt").alias("path"), "body")


@query("""SELECT doc_id::VARCHAR AS candidate_id, CASE doc_id % 4 WHEN 3 THEN 1 ELSE 2 END::INTEGER AS n_edits, CASE doc_id % 4 WHEN 3 THEN 1 ELSE 0 END::INTEGER AS malformed, CASE doc_id % 4 WHEN 1 THEN 'search_not_found' WHEN 2 THEN 'ambiguous_match' END AS first_failure,
  doc_id % 4 IN (0, 3) AS would_apply, doc_id % 4 IN (1, 2) AS partial, CASE WHEN doc_id % 4 = 0 THEN '0,1' ELSE '0' END AS accepted FROM documents""")
def edit_scripts(spark, sf):
    """Answers parsed and replayed: an edit that fits, one that finds nothing, one that finds two places, and a block without its divider."""
    scripts = written(scripted(spark, sf))
    out = edits.replay_scripts(scripts, sources_of(scripts))
    return out.select("candidate_id", F.size("edits").alias("n_edits"), F.col("malformed_blocks").alias("malformed"), "replay.first_failure", "replay.would_apply", "replay.partial", F.array_join(F.col("replay.accepted").cast("array<string>"), ",").alias("accepted"))


@query("""SELECT doc_id::VARCHAR AS candidate_id, 'src/doc.txt' AS path, concat_ws(chr(10), 'first', 'mid ' || source, 'mid ' || source, CASE doc_id % 4 WHEN 0 THEN 'second' || chr(10) ELSE 'end' END) AS body FROM documents WHERE doc_id % 4 IN (0, 3)""")
def edit_apply(spark, sf):
    """Files after scripts that fit as a whole."""
    scripts = written(scripted(spark, sf))
    return edits.apply_scripts(scripts, sources_of(scripts)).select("candidate_id", "path", "body")


@query("""SELECT doc_id % 4 AS kind, count(*) AS n, count(*) FILTER (doc_id % 4 IN (1, 2)) AS never_applied, count(*) FILTER (doc_id % 4 IN (1, 2)) AS partial, count(*) FILTER (doc_id % 4 IN (1, 2)) AS substantive,
  sum(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END)::BIGINT AS edits_kept, sum(CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 2 END)::BIGINT AS edits FROM documents GROUP BY 1""")
def edit_apply_loss(spark, sf):
    scripts = written(scripted(spark, sf))
    out = edits.replay_scripts(scripts, sources_of(scripts)).withColumn("kind", F.col("candidate_id").cast("bigint") % 4)
    return evaluation.apply_loss(out, "kind")


@query("""SELECT doc_id::VARCHAR AS candidate_id, true AS would_apply, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END::INTEGER AS n FROM documents""")
def edit_reduced(spark, sf):
    """Scripts cut to their accepted edits apply as a whole."""
    scripts = written(scripted(spark, sf))
    sources = sources_of(scripts)
    first = edits.replay_scripts(scripts, sources).withColumn("accepted", F.col("replay.accepted"))
    again = edits.replay_scripts(written(edits.reduced(first).drop("replay", "accepted")), sources)
    return again.select("candidate_id", "replay.would_apply", F.size("edits").alias("n"))


@query("""SELECT doc_id::VARCHAR AS snapshot, 'a' AS path, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS body FROM documents UNION ALL SELECT doc_id::VARCHAR, 'new', 'n' FROM documents WHERE doc_id % 3 = 2""")
def edit_mounts(spark, sf):
    d = table(spark, sf, "documents").withColumn("snapshot", F.col("doc_id").cast("string"))
    base = d.select("snapshot", F.lit("a").alias("path"), F.col("lang").alias("body"))
    over = d.where("doc_id % 3 < 2").select("snapshot", F.lit("a").alias("path"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("body"))
    return edits.with_mounts(base, over.unionByName(d.where("doc_id % 3 = 2").select("snapshot", F.lit("new").alias("path"), F.lit("n").alias("body"))))


@query("""SELECT doc_id::VARCHAR AS candidate_id, CASE doc_id % 3 WHEN 0 THEN 'write:src/a.js' WHEN 1 THEN 'write:src/a.js,delete:old.js' ELSE '' END AS ops, CASE doc_id % 3 WHEN 0 THEN '// ... rest of the file' ELSE '' END AS marker, CASE doc_id % 3 WHEN 2 THEN 1 ELSE 0 END::INTEGER AS malformed,
  CASE WHEN doc_id % 3 < 2 THEN lang || chr(10) || CASE doc_id % 3 WHEN 0 THEN '// ... rest of the file' || chr(10) ELSE '' END END AS body FROM documents""")
def edit_whole_files(spark, sf):
    fence = lambda more: F.concat(F.lit("src/a.js\n```js\n"), F.col("lang"), F.lit("\n" + more + "```\n"))
    answer = cases(fence("// ... rest of the file\n"), F.concat(fence(""), F.lit(">>> DELETE old.js\n")), F.concat(F.lit("```\n"), F.col("lang"), F.lit("\n```\n")))
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), F.lit("whole_file").alias("format"), answer.alias("response"))
    out = edits.parse_answers(d)
    ops = F.transform("script.edits", lambda e: F.concat(e["op"], F.lit(":"), e["path"]))
    return out.select("candidate_id", F.array_join(ops, ",").alias("ops"), F.col("script.elision_marker").alias("marker"), F.col("script.malformed_blocks").alias("malformed"), F.get("script.edits", F.lit(0))["content"].alias("body"))


@query("""SELECT doc_id::VARCHAR AS candidate_id, CASE doc_id % 3 WHEN 2 THEN 0 ELSE 2 END::INTEGER AS n_edits, CASE WHEN doc_id % 3 < 2 THEN 'ctx' || chr(10) || lang || chr(10) END AS search, CASE WHEN doc_id % 3 < 2 THEN 'ctx' || chr(10) || source || chr(10) END AS content,
  CASE WHEN doc_id % 3 < 2 THEN 'delete:gone.txt' END AS last FROM documents""")
def edit_diffs(spark, sf):
    """Unified diffs, fenced, bare with a cut header, or absent: as search and replace blocks, and parsed again."""
    head = lambda git: F.lit(git + " a/src/a.txt b/src/a.txt\n--- a/src/a.txt\n+++ b/src/a.txt\n@@ -1,2 +1,2 @@\n ctx\n-")
    rest = F.lit("\ndiff --git a/gone.txt b/gone.txt\n--- a/gone.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n")
    diff = lambda git: F.concat(head(git), F.col("lang"), F.lit("\n+"), F.col("source"), rest)
    answer = cases(F.concat(F.lit("Here:\n```diff\n"), diff("diff --git"), F.lit("```\nbye")), F.concat(F.lit("Here it is.\n"), diff("diff --git")), "no patch")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), edits.find_diff_udf(answer).alias("diff"))
    blocks = edits.arrow_udf(lambda x: edits.diff_as_search_replace(x) if x else "", "string")
    out = edits.parse_answers(d.select("candidate_id", F.lit("search_replace").alias("format"), blocks("diff").alias("response")))
    first, last = F.get("script.edits", F.lit(0)), F.get("script.edits", F.lit(1))
    return out.select("candidate_id", F.size("script.edits").alias("n_edits"), first["search"].alias("search"), first["content"].alias("content"), F.concat(last["op"], F.lit(":"), last["path"]).alias("last"))


# Progress


@query("""SELECT lang AS project_id, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS stage, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY ALL""")
def progress_summary(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("file_path"))
    empty = spark.createDataFrame([], "project_id string, file_path string, stage string, llm_results string")
    marks = table(spark, sf, "labels").groupBy(F.col("doc_id").cast("string").alias("file_path")).agg(F.max("quality").alias("q"))
    marks = d.join(marks, "file_path").where("q is not null").select("project_id", "file_path", F.when(F.col("q") == 1, "completed").otherwise("failed").alias("stage"), F.lit("{}").alias("llm_results"))
    return progress.summary(progress.mark(progress.register(empty, d), marks))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'old' WHEN d.lang = 'en' THEN 'new' END AS answer FROM (SELECT DISTINCT doc_id, lang FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def cache_answers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").distinct().withColumn("key", F.col("doc_id").cast("string"))
    old = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key")).distinct().withColumn("answer", F.lit("old"))
    new = d.where("lang = 'en'").select("key", F.lit("new").alias("answer"))
    return progress.answered(d, old, new).select("doc_id", "answer")


@query("""SELECT n_name AS key, CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN 'x' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation""")
def key_value_state(spark, sf):
    t = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return progress.state(t, t.agg(F.min("key")).first()[0], "x")


# Evaluation and its gates


@query(f"""WITH {RESULTS_SQL} SELECT candidate_id, stage, apply_mode FROM (SELECT candidate_id, stage, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN 'strict' ELSE apply_mode END AS apply_mode FROM results)
  WHERE (stage IN ('test_pass', 'test_fail', 'build_fail') AND apply_mode IS NULL) OR (stage IN ('diff_apply_fail', 'timeout_at_apply') AND apply_mode = 'strict')""")
def gate_contradictions(spark, sf):
    r = binding.results(spark, sf)
    mode = F.when(F.col("seq") % 3 == 0, F.lit(None).cast("string")).when(F.col("seq") % 3 == 1, "strict").otherwise(F.col("apply_mode"))
    return evaluation.contradictions(r.withColumn("apply_mode", mode)).select("candidate_id", "stage", "apply_mode")


@query("""SELECT doc_id::VARCHAR AS candidate_id, name, CASE name WHEN 'log' THEN 'empty' ELSE 'missing' END AS problem FROM documents, (VALUES ('log'), ('diff')) t(name) WHERE (name = 'log' AND doc_id % 2 = 0) OR (name = 'diff' AND doc_id % 3 = 0)""")
def gate_missing_artifacts(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), "doc_id")
    sizes = F.array(F.struct(F.lit("log").alias("name"), F.when(F.col("doc_id") % 2 == 0, 0).otherwise(9).alias("size")), F.struct(F.lit("diff").alias("name"), F.lit(4).alias("size")), F.struct(F.lit("result").alias("name"), F.lit(1).alias("size")))
    listing = c.select("candidate_id", "doc_id", F.inline(sizes)).where("not (name = 'diff' and doc_id % 3 = 0)").drop("doc_id")
    return evaluation.missing_artifacts(listing, c, ["log", "diff", "result"])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def gate_set_differences(spark, sf):
    return evaluation.set_differences(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")))


@query("""SELECT o_custkey, CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) <> 1""")
def gate_one_value(spark, sf):
    return evaluation.not_one_value(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus")).select("o_custkey", F.size("values").alias("n"))


@query("""SELECT doc_id, n_chars FROM documents WHERE n_chars > 2000 OR n_chars <= 0""")
def gate_over_budget(spark, sf):
    return evaluation.over_budget(table(spark, sf, "documents").withColumn("budget", F.lit(2000)), "n_chars", "budget").select("doc_id", "n_chars")


@query("""SELECT CAST(sum(CASE WHEN l_returnflag <> 'A' THEN l_linenumber END) AS BIGINT) AS parts, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS BIGINT) AS total FROM lineitem""")
def gate_sums(spark, sf):
    return evaluation.sums_differ(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", total="A")


@query("""SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))""")
def gate_unclaimed(spark, sf):
    """Claims that no text holds; by the operator for short report tables, after containment by shared words has found the others."""
    claims, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    held = resolve.contained_specs(docs, claims, "text", "text", "doc_id", "item_id").select("doc_id").distinct()
    return evaluation.not_contained(docs.join(held, "doc_id", "left_semi"), "text", claims, "text").select("item_id")


@query("""SELECT lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS result, count(*) AS n FROM documents GROUP BY ALL""")
def result_census(spark, sf):
    return evaluation.distinct_results(table(spark, sf, "documents"), ["lang"], F.when(F.col("n_chars") > 1000, "long").otherwise("short"))


@query("""WITH j AS (SELECT lang, doc_id % 3 + 1 AS calls, 1 + (doc_id % 2) AS hit, CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END AS fp, CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END AS fn FROM documents),
  s AS (SELECT lang, CAST(sum(hit * calls) AS BIGINT) AS tp, CAST(sum(fp * calls) AS BIGINT) AS fp, CAST(sum(fn * calls) AS BIGINT) AS fn FROM j GROUP BY 1)
  SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM s""")
def micro_precision_recall(spark, sf):
    """Wanted are a and b; got are both, or a and c."""
    d = table(spark, sf, "documents").select("lang", (F.col("doc_id") % 3 + 1).alias("calls"), F.array(F.lit("a"), F.lit("b")).alias("wanted"), F.array(F.lit("a"), F.when(F.col("doc_id") % 2 == 1, "b").otherwise("c")).alias("got"))
    return rounded(evaluation.micro_average(d, "lang"), "precision", "recall", "f1", digits=9)


@query("""SELECT lang AS task_id, string_agg(f, ',' ORDER BY f) AS solution, min(doc_id) AS witness FROM (SELECT lang, doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['a', 'b'] ELSE ['b'] END) AS f, doc_id % 3 AS k FROM documents) GROUP BY lang, k, doc_id
  QUALIFY row_number() OVER (PARTITION BY lang, string_agg(f, ',' ORDER BY f) ORDER BY doc_id) = 1""")
def witnessed(spark, sf):
    """Edited files without those created; each different set with its first witness."""
    edited = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("c"), F.lit("a"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    d = table(spark, sf, "documents").select(F.col("lang").alias("task_id"), F.col("doc_id").alias("candidate_id"), F.col("doc_id").alias("seq"), edited.alias("edited"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("c"))).alias("created"))
    return evaluation.witnessed_solutions(d).select("task_id", F.array_join("solution", ",").alias("solution"), "witness")


@query("""SELECT lang, count(*) AS passes, CAST(count(*) FILTER (doc_id % 2 = 0 AND lang <> 'de') AS BIGINT) AS extra, count(*) + count(*) FILTER (doc_id % 2 = 0 AND lang <> 'de') AS counterfactual FROM documents GROUP BY 1""")
def counterfactual_totals(spark, sf):
    d = table(spark, sf, "documents")
    return evaluation.with_replays(d.groupBy("lang").agg(F.count("*").alias("passes")), d.where("lang != 'de'").select("lang", (F.col("doc_id") % 2 == 0).alias("passed")), "lang")


@query("""SELECT r_name AS task_id, c AS condition, CAST(k AS INTEGER) AS replicate, r_name || '__' || c || '__n' || k AS candidate_id FROM region, (SELECT DISTINCT o_orderpriority AS c FROM orders), range(1, 4) t(k)""")
def candidate_matrix(spark, sf):
    return evaluation.candidate_matrix(table(spark, sf, "region").select(F.col("r_name").alias("task_id")), table(spark, sf, "orders").select(F.col("o_orderpriority").alias("condition")).distinct(), 3)


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'setup_crash' WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'timeout_at_apply' ELSE 'diff_apply_fail' END WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'timeout_at_install' ELSE 'install_fail' END
  WHEN doc_id % 5 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'timeout_at_build' ELSE 'build_fail' END WHEN doc_id % 5 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'timeout_at_test' ELSE 'test_fail' END ELSE 'test_pass' END AS stage FROM documents""")
def harness_stages(spark, sf):
    steps = F.slice(F.array(*map(F.lit, ("apply_ok", "install_ok", "build_ok", "test_ok"))), 1, (F.col("doc_id") % 5).cast("int"))
    marks = F.when(F.col("doc_id") % 7 == 0, F.concat(steps, F.array(F.lit("setup_crash")))).otherwise(steps)
    return evaluation.stage_of_flags(table(spark, sf, "documents").select("doc_id", marks.alias("marks"), (F.col("doc_id") % 2 == 0).alias("timed_out"))).select("doc_id", "stage")


@query(f"""WITH {RESULTS_SQL}, r AS (SELECT condition, CASE WHEN seq % 10 = 0 THEN 'harness_error' ELSE stage END AS stage FROM results WHERE seq % 10 <> 1)
  SELECT condition, count(*) AS n, count(*) FILTER (stage = 'harness_error') AS harness_errors, count(*) FILTER (stage = 'test_pass') AS test_passes FROM r GROUP BY 1""")
def run_summaries(spark, sf):
    """Candidates that failed before they ran become rows of their own; planned ones without an error are in no row."""
    r = binding.results(spark, sf)
    planned = r.select("candidate_id", "condition", "task_id", "seq")
    errors = r.where("seq % 10 = 0").select("candidate_id", F.lit("boom").alias("message"))
    done = r.where("seq % 10 > 1").select("candidate_id", "condition", "task_id", "stage", "seq")
    return evaluation.run_summary(spark, evaluation.orchestrator_errors(planned, done, errors))


@query(f"""WITH {CALLS_SQL} SELECT run_id, condition_id, task_id, count(*) AS candidates FROM calls WHERE call_purpose = 'generator' GROUP BY ALL""")
def candidates_by_run(spark, sf):
    return cost.candidates(binding.calls(spark, sf))


@query("""WITH b AS (SELECT DISTINCT label % 3 AS kind, vec_id // 4 AS b FROM embeddings WHERE vec_id % 4 = 0) SELECT 'k' || kind AS kind, CAST(sum(b * 2) AS BIGINT) AS prompt_tokens, median(b % 9 + 1) AS median_size FROM b GROUP BY 1""")
def embedding_index_cost(spark, sf):
    """Batches that four rows name count once each."""
    e = table(spark, sf, "embeddings")
    b = F.floor(F.col("vec_id") / 4)
    kind = e.where("vec_id % 4 = 0").select(b.alias("b"), F.concat(F.lit("k"), (F.col("label") % 3).cast("string")).alias("kind"))
    rows = e.select(b.alias("b")).join(kind, "b").select(F.col("b").alias("batch_id"), "kind", (F.col("b") * 2).alias("prompt_tokens"), (F.col("b") % 9 + 1).alias("size"))
    return cost.index_cost(rows)


# Retrieval figures


@query("""SELECT r_name AS task_id, CAST(10 * r_regionkey + 5 AS BIGINT) AS budget FROM region""")
def matched_budgets(spark, sf):
    """Both runs of a task used the same tokens, which become its budget."""
    r = table(spark, sf, "region").select(F.col("r_name").alias("task_id"), (F.col("r_regionkey") * 10 + 5).cast("bigint").alias("tokens"))
    return retrieval.with_budgets(r.select("task_id"), retrieval.matched_budgets(r.unionByName(r))).select("task_id", "budget")


@query("""SELECT lang AS task_id, source AS retriever, CAST(sum(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept, 2 * count(*) AS wanted FROM documents GROUP BY ALL""")
def retrieval_recall(spark, sf):
    got = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("z")))
    d = table(spark, sf, "documents")
    wanted = d.select(F.col("lang").alias("task_id")).distinct().withColumn("targets", F.array(F.lit("a"), F.lit("b")))
    return retrieval.recall(d.select(F.col("lang").alias("task_id"), F.col("source").alias("retriever"), got.alias("files")), wanted, "retriever")


@query("""SELECT lang AS project_id, source AS path, CASE WHEN bool_or(n_chars > 5000) THEN 'items' ELSE 'empty' END AS stratum FROM documents GROUP BY ALL""")
def file_strata(spark, sf):
    return retrieval.strata(table(spark, sf, "documents").select(F.col("lang").alias("project_id"), F.col("source").alias("path"), "n_chars"), F.col("n_chars") > 5000)


@query("""WITH c AS (SELECT lang AS project_id, CAST(doc_id AS VARCHAR) AS path, unnest(CASE WHEN doc_id % 2 = 0 THEN ['A', 'B'] ELSE ['B'] END) AS type, doc_id % 50 = 0 AS s FROM documents)
  SELECT type, count(*) AS files, coalesce(string_agg(project_id || '/' || path, ',' ORDER BY project_id || '/' || path) FILTER (s), '') AS sampled FROM c GROUP BY 1""")
def coverage_tables(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("path"), "doc_id")
    covered = d.withColumn("types", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"))))
    return retrieval.coverage_table(covered, d.where("doc_id % 50 = 0")).select("type", "files", F.array_join("sampled", ",").alias("sampled"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS task_id, p AS path, CASE p WHEN 'a' THEN lang END AS source, p <> 'a' AS missing FROM documents, (VALUES ('a'), ('new')) t(p) WHERE p = 'a' OR doc_id % 2 = 0""")
def whole_file_contexts(spark, sf):
    d = table(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string"))
    tasks = d.select(F.col("id").alias("task_id"), F.col("id").alias("project_id"), F.array(F.lit("a")).alias("files_modified"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("new"), F.lit("a"))).alias("files_created"))
    return context.whole_files(tasks, d.select(F.col("id").alias("project_id"), F.lit("a").alias("path"), F.col("lang").alias("source"))).drop("project_id")


@query("""SELECT CAST(doc_id AS VARCHAR) AS task_id, '' AS context, 0 AS tokens, doc_id % 4 <> 3 AS stop FROM documents""")
def floor_contexts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("task_id"), cases(" stop ", "[STOP]", None, "go on").alias("query"))
    return context.floor(d).join(d.select("task_id", context.is_stop(F.col("query")).alias("stop")), "task_id")


def words(expr: str) -> str:
    """The token estimate of an SQL string."""
    return f"CAST(floor(len(list_filter(string_split_regex(coalesce({expr}, ''), '\\s+'), lambda w: w <> '')) * 1.3) AS BIGINT)"


@query(f"""WITH {GRAPH_SQL}, parts AS (SELECT project_id || '/' || name AS project_id, {words("'export ' || file_path")} AS source,
    {words("(SELECT string_agg(v, ' ' ORDER BY v) FROM prio p WHERE p.id = x.id AND x.k = 'c')")} AS props,
    {words("CASE WHEN x.k = 'c' THEN x.export ELSE '' END || CASE WHEN (x.k = 'c' AND x.id % 3 = 0) OR (x.k = 's' AND x.id % 2 = 0) THEN ' use' || x.file_path ELSE '' END")} AS hooks,
    {words("CASE WHEN x.k = 's' THEN 's' ELSE (SELECT string_agg(v, ' ') FROM years y WHERE y.id = x.id) END")} AS state,
    CASE WHEN (x.k = 'c' AND x.id % 3 = 0) OR (x.k = 's' AND x.id % 2 = 0) THEN {words("'export ' || file_path")} ELSE 0 END AS secondary,
    (SELECT count(DISTINCT d.supp) FROM deals d WHERE d.cust = x.id AND x.k = 'c') AS n_parents,
    (SELECT coalesce(sum(t), 0) FROM (SELECT DISTINCT s.uid, {words("s.name || ' ' || s.file_path")} AS t FROM deals d JOIN supp s ON s.id = d.supp WHERE d.cust = x.id AND x.k = 'c')) AS parents,
    {words("(SELECT x.name || ' event handlers: ' || string_agg(v || '→on' || v, ', ' ORDER BY v) FROM status s WHERE s.id = x.id AND x.k = 'c')")} AS notes FROM comp x),
  t AS (SELECT *, source + props + hooks + state + secondary + parents + notes AS t0, source + props + hooks + state + secondary + notes AS t1, source + props + hooks + state + secondary AS t2, source + props + secondary AS t3, source + secondary AS t4, source AS t5 FROM parts)
  SELECT project_id, CAST(CASE WHEN t0 <= 20 THEN t0 WHEN t1 <= 20 THEN t1 WHEN t2 <= 20 THEN t2 WHEN t3 <= 20 THEN t3 WHEN t4 <= 20 THEN t4 ELSE t5 END AS BIGINT) AS tokens, CAST(CASE WHEN t0 <= 20 THEN n_parents ELSE 0 END AS INTEGER) AS neighbours,
    CAST(CASE WHEN secondary > 0 AND (t0 <= 20 OR t1 <= 20 OR t2 <= 20 OR t3 <= 20 OR t4 <= 20) THEN 1 ELSE 0 END AS INTEGER) AS secondary, CAST(CASE WHEN notes > 0 AND (t0 <= 20 OR t1 <= 20) THEN 1 ELSE 0 END AS INTEGER) AS notes FROM t""")
def context_ladder(spark, sf):
    """The context of every component, a request each, cut step by step until its estimate fits 20 tokens."""
    built_of = _assembled(spark, sf, 20)
    a = F.col("assembly")
    return built_of.select("project_id", "tokens", F.size(a["neighbours"]).alias("neighbours"), F.size(a["secondary"]).alias("secondary"), F.size(a["droppable_notes"]).alias("notes"))


def _assembled(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    g = binding.graph(spark, sf_dir, INTERFACE_LABELS, [*INTERFACE_RELS, "PASSES_PROP"], store=True)
    rows = written(templates.bug_fix(g, components_only(g)))
    one = rows.withColumn("project_id", F.concat("project_id", F.lit("/"), "componentName"))
    sources = one.select("project_id", F.col("filePath").alias("path")).distinct().withColumn("source", F.concat(F.lit("export "), "path"))
    return context.assemble(one, sources, "bug_fix", budget=budget)


@query(f"""WITH {GRAPH_SQL}, used AS (SELECT x.*, (x.k = 'c' AND x.id % 3 = 0) OR (x.k = 's' AND x.id % 2 = 0) AS u,
    (SELECT string_agg(v, ', ' ORDER BY v) FROM prio p WHERE p.id = x.id AND x.k = 'c') AS props, (SELECT string_agg(v || '→on' || v, ', ' ORDER BY v) FROM status s WHERE s.id = x.id AND x.k = 'c') AS handlers,
    CASE WHEN x.k = 's' THEN 's' || (x.id % 3) ELSE (SELECT string_agg(v, ', ' ORDER BY v) FROM years y WHERE y.id = x.id) END AS state,
    (SELECT string_agg(t, '' ORDER BY n, f, uid) FROM (SELECT DISTINCT s.name AS n, s.file_path AS f, s.uid, chr(10) || chr(10) || '**' || s.name || '** (`' || s.file_path || '`)' || chr(10) || '- renders the target and passes props to it' AS t
      FROM deals d JOIN supp s ON s.id = d.supp WHERE d.cust = x.id AND x.k = 'c')) AS related FROM comp x)
  SELECT project_id || '/' || name AS project_id, '## Project Context' || chr(10) || chr(10) || 'You are working on the **' || project_id || '/' || name || '** React project.' || chr(10) || chr(10) || '**Task type:** bug_fix' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || '### Target Components' || chr(10) || chr(10) || '#### ' || name || ' (`' || file_path || '`)' || chr(10) || chr(10) || '```jsx' || chr(10) || 'export ' || file_path || chr(10) || '```' || chr(10)
    || CASE WHEN props IS NOT NULL THEN '**Props:** ' || props || chr(10) ELSE '' END
    || CASE WHEN k = 'c' OR u THEN '**Hooks used:** ' || concat_ws(', ', CASE WHEN k = 'c' THEN export END, CASE WHEN u THEN 'use' || file_path END) || chr(10) ELSE '' END
    || CASE WHEN state IS NOT NULL THEN '**State:** ' || state || chr(10) ELSE '' END
    || CASE WHEN u THEN chr(10) || '#### use' || file_path || ' (`' || file_path || '`)' || chr(10) || chr(10) || '```jsx' || chr(10) || 'export ' || file_path || chr(10) || '```' || chr(10) ELSE '' END
    || CASE WHEN related IS NOT NULL THEN chr(10) || '---' || chr(10) || chr(10) || '### Related Components' || related || chr(10) ELSE '' END
    || CASE WHEN handlers IS NOT NULL THEN chr(10) || '---' || chr(10) || chr(10) || '### Cross-Cutting Notes' || chr(10) || chr(10) || '- ' || name || ' event handlers: ' || handlers || chr(10) ELSE '' END AS context FROM used""")
def context_render(spark, sf):
    """The whole context of every component as text."""
    whole = _assembled(spark, sf, 1_000_000)
    return context.render(whole.withColumn("task_type", F.lit("bug_fix"))).select("project_id", "context")
