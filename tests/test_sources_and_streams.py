import base64
import json

import numpy as np
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.operators import progress
from graphloom.sources import files, logs, sinks
from graphloom.streaming import logs as stream


def test_walk_and_packages(spark, tmp_path):
    root = tmp_path / "shop"
    for name in ("src/App.tsx", "src/a.test.ts", "src/types.d.ts", "node_modules/x/i.js", "src/__tests__/b.js", "vite.config.ts", "src/skip/c.ts", "src/skipped.ts", "README.md", ".eslintrc.js", "src/.ts"):
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
    (root / "src/bad.js").write_bytes(b"\xff\xfe")
    found = files.walk(spark, str(root), "p", ["src/skip"])
    assert sorted(r.file_path for r in found.collect()) == ["src/App.tsx", "src/bad.js", "src/skipped.ts"]
    assert sorted(r.path for r in files.corpus(spark, str(root), "p", ["src/skip"]).collect()) == ["src/App.tsx", "src/skipped.ts"]
    (root / "package.json").write_text(json.dumps({"name": "shop", "dependencies": {"react": "18", "@radix-ui/x": "1"}, "devDependencies": {"react": "17", "left-pad": "1"}}))
    packs = files.packages(spark, str(root / "package.json"))
    libs = {r.name: (r.version, r.category, r.dependencyType) for r in files.libraries(packs).collect()}
    assert libs == {"react": ("18", "framework", "production"), "@radix-ui/x": ("1", "ui-library", "production"), "left-pad": ("1", "other", "development")}
    row = files.projects(packs).first()
    import hashlib

    assert row.project_id == hashlib.sha256(str(root).encode()).hexdigest()[:12] and row.name == "shop"
    assert sinks.file_manifest(found).first().file_count == 3


def test_logs(spark, tmp_path):
    assert logs.calls(spark, str(tmp_path / "missing")).count() == 0
    log = tmp_path / "calls.jsonl"
    log.write_text('{"model_id": "m", "usage": {"input_tokens": 3}, "prompt": [{"role": "user", "content": "a"}, {"content": "b"}]}\n\n{"model_id": "n"}\n')
    rows = logs.calls(spark, str(log)).select("model_id", logs.prompt_text(F.col("prompt")).alias("t")).orderBy("model_id").collect()
    assert [tuple(r) for r in rows] == [("m", "a\nb"), ("n", "")]
    vector = base64.b64encode(np.array([1.5, -2.0], "<f4").tobytes()).decode()
    cache = tmp_path / "e.jsonl"
    cache.write_text("\n".join(json.dumps({"key": "k", "label": x, "embedding_b64": vector}) for x in ("first", "second")))
    row = logs.embeddings(spark, str(cache)).first()
    assert row.label == "first" and row.embedding == [1.5, -2.0]
    assert spark.range(1).select(logs.encode_vector(F.array(F.lit(1.5), F.lit(-2.0)).cast("array<float>")).alias("b")).first().b == base64.b64decode(vector)


def test_answers_headers_and_tables(spark):
    texts = ['```json\n{"task_type": "refactoring", "anchor_names": ["A", null]}\n```', 'Sure: {"task_type": "odd", "anchor_names": ["B"], "anchor_routes": ["/x"]} ok', "no json", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", logs.classifier_answer(F.col("t")).alias("a")).orderBy("i")
    assert [(r.a.task_type, r.a.anchor_names, r.a.anchor_routes) for r in df.collect()] == [("refactoring", ["A"], []), ("bug_fix", ["B"], ["/x"]), ("bug_fix", [], []), ("bug_fix", [], [])]
    h = spark.range(1).select(F.create_map(F.lit("LLM_Provider-X-Provider-Name"), F.lit("g"), F.lit("Retry-After"), F.lit("3"), F.lit("llm_provider-retry-after"), F.lit("9"), F.lit("e"), F.lit("")).alias("h"))
    row = h.select(logs.headers(F.col("h")).alias("x"), logs.provider(F.lit(None).cast("string"), F.col("h")).alias("p")).first()
    assert row.x == {"retry-after": "3", "x-provider-name": "g"} and row.p == "g"
    md = "intro\n## Totals\ntext\n| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\nend\n| no | t |"
    assert spark.range(1).select(logs.table_after(F.lit(md), "## Totals").alias("t")).first().t == [["1", "x"], ["2", "y"]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    assert sinks.markdown(df.orderBy("k")) == "| k | v |\n|---|---|\n| a | 1.5 |\n| b | – |\n"
    sinks.report_csv(df, str(tmp_path / "csv"), ["v", "k"])
    assert logs.table(spark, str(tmp_path / "csv"), "v double, k string").count() == 2
    path = tmp_path / "t.toml"
    path.write_text("P1 = 3\nP2 = 4\n")
    assert sinks.merge_toml(str(path), {"P2": 5, "P3": 6}) == {"P1": 3, "P2": 5, "P3": 6} == logs.toml(str(path))
    cache = spark.createDataFrame([("a", 0)], "key string, v int")
    sinks.append_cache(cache, spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "key string, v int"), str(tmp_path / "cache"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "cache")).collect()] == [("b", 2)]
    assert sinks.read_provenance(str(tmp_path / "none")) is None
    out = sinks.provenance(str(tmp_path / "p.json"), {"run": 1}, {"b": b"2", "a": b"1"})
    assert sinks.read_provenance(str(tmp_path / "p.json")) == out


def test_progress(spark):
    empty = spark.createDataFrame([], "project_id string, file_path string, stage string, llm_results string")
    files_ = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "project_id string, file_path string")
    table = progress.mark(progress.register(empty, files_), spark.createDataFrame([("p", "a", "completed", "{}"), ("x", "a", "failed", None)], "project_id string, file_path string, stage string, llm_results string"))
    assert [r.file_path for r in progress.pending(table, "p").collect()] == ["b"] and [r.file_path for r in progress.completed(table, "p").collect()] == ["a"]
    assert progress.register(table, files_).count() == 3 and {(r.project_id, r.stage): r.n for r in progress.summary(table).collect()} == {("p", "completed"): 1, ("p", "pending"): 1, ("q", "pending"): 1}
    kv = progress.state(spark.createDataFrame([("a", "1")], "key string, value string"), "a", "2")
    assert [tuple(r) for r in kv.collect()] == [("a", "2")] and progress.has_current_key(table.columns)


def test_stored_tables(spark):
    from graphloom.sources import store

    df = store.written(spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string"), "k")
    assert df.columns == ["i", "k"] and df.count() == 2 and store.clear(spark) >= 1 and store.clear(spark) == 0


def record(stage, tokens, at, file="f"):
    return json.dumps({"timestamp": at, "stage": stage, "prompt_id": "p", "file_path": file, "cache_hit": False, "attempts": 1, "usage": {"input_tokens": tokens, "output_tokens": 1}}) + "\n"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text(record("per_file", 5, "2026-01-01T00:10:00") + record("cross", 7, "2026-01-01T00:50:00"))
    totals = {}

    def keep(batch, _):
        totals.update({r.stage: r.input_tokens for r in batch.collect()})

    def run():
        q = stream.usage(stream.read(spark, str(src))).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run()
    (src / "2.json").write_text(record("per_file", 10, "2026-01-01T02:00:00"))
    run()
    assert totals == {"per_file": 15, "cross": 7}
    batch = {r.stage: r.input_tokens for r in stream.summarise(spark, str(src)).where("level = 1").collect()}
    assert batch == totals
    windows = []
    q = stream.usage_by_window(stream.read(spark, str(src), schemas.EXTRACTION_LOG)).writeStream.outputMode("complete").foreachBatch(lambda b, _: windows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r.calls for r in windows) == 3


def test_stream_into_a_keyed_table(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    kind = "file_path string, project_id string, stage string, updated_at timestamp"
    line = lambda f, s, m: json.dumps({"file_path": f, "project_id": "p", "stage": s, "updated_at": f"2026-01-01T00:{m:02d}:00"}) + "\n"
    for i, text in enumerate((line("a", "extracting", 1) + line("b", "failed", 1), line("a", "completed", 2))):
        (src / f"{i}.json").write_text(text)
        stream.into_table(stream.read(spark, str(src), kind), str(tmp_path / "t"), ["project_id", "file_path"], str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "t" / "v1"))
    assert {r.file_path: r.stage for r in got.collect()} == {"a": "completed", "b": "failed"}
