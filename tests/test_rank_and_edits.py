import json
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import edits, rank


def plain_bm25(docs, query):
    n, lengths = len(docs), [len(d) for d in docs]
    avg = sum(lengths) / n
    out = []
    for d, dl in zip(docs, lengths, strict=True):
        score = 0.0
        for t in query:
            df = sum(t in x for x in docs)
            tf = d.count(t)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
        out.append(score)
    return out


def test_bm25_against_a_loop(spark):
    r = random.Random(2)
    docs = [[r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(r.randrange(0, 30))] for _ in range(40)]
    query = ["alpha", "zeta", "alpha", "unknown"]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id int, t string")
    asked = spark.createDataFrame([(1, " ".join(query))], "q int, t string")
    got = {r.doc_id: r.score for r in rank.bm25(frame, asked, "id", F.col("t"), "q", F.col("t")).collect()}
    want = plain_bm25(docs, query)
    assert all(got.get(i, 0.0) == pytest.approx(w) for i, w in enumerate(want))


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 9) for r in df.select(rank.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, -1.0]


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_against_a_loop(spark, seed):
    r = random.Random(seed)
    costs = [r.randrange(1, 60) for _ in range(25)]
    used, kept, passed = 7, [], []
    for i, c in enumerate(costs):
        if used + c <= 100:
            used, kept = used + c, [*kept, i]
        else:
            passed.append(i)
    frame = spark.createDataFrame([("g", i, c, 7) for i, c in enumerate(costs)], "g string, i int, c int, s int")
    got = rank.first_fit(frame, "g", ["i"], "i", "c", 100, "s").first()
    assert (got.included, got.skipped, got.used) == (kept, passed, used)


def test_context_fills_in_rank_order(spark):
    docs = spark.createDataFrame([(f"d{i}", "cart " + "word " * 999) for i in range(10)] + [("none", "nothing here")], "path string, source string")
    got = rank.bm25_context(docs, spark.createDataFrame([(1, "cart")], "query_id int, spec string")).first()
    assert got.included == [f"d{i}" for i in range(5)] and len(got.skipped) == 5
    big = spark.createDataFrame([("a", "cart cart " + "w " * 10_000), ("b", "cart w")], "path string, source string")
    assert rank.bm25_context(big, spark.createDataFrame([(1, "cart")], "query_id int, spec string")).first().included == ["b"]


BLOCK = "src/a.ts\n<<<<<<< SEARCH\nold\n=======\nnew\n>>>>>>> REPLACE\n"


@pytest.mark.parametrize("answer,ops,malformed", [
    (BLOCK, [("src/a.ts", "replace")], 0), ("```ts\n" + BLOCK + "```", [("src/a.ts", "replace")], 0), ("**src/b.ts**\n<<<<<<< SEARCH\n\n=======\nx\n>>>>>>> REPLACE", [("src/b.ts", "write")], 0),
    ("<<<<<<< SEARCH src/c.ts\na\n=======\nb\n>>>>>>> REPLACE\n<<<<<<< SEARCH\nc\n=======\nd\n>>>>>>> REPLACE", [("src/c.ts", "replace"), ("src/c.ts", "replace")], 0), (">>> DELETE src/d.ts", [("src/d.ts", "delete")], 0),
    ("src/a.ts\n<<<<<<< SEARCH\nx\n>>>>>>> REPLACE\n", [], 1), ("src/a.ts\n<<<<<<< SEARCH\nx\n=======\ny", [], 1), ("<<<<<<< SEARCH\nx\n=======\ny\n>>>>>>> REPLACE", [], 1), ("", [], 0), (None, [], 0), ("Now update the reducer:\n", [], 0),
])
def test_search_replace(answer, ops, malformed):
    got = edits.parse_search_replace(answer)
    assert [(e["path"], e["op"]) for e in got["edits"]] == ops and got["malformed_blocks"] == malformed


def test_whole_files():
    got = edits.parse_whole_files("src/a.tsx\n```tsx\nline\n// ... rest of the file unchanged\n```\n```ts b/src/b.ts\nx\n```\nDELETE src/c.ts\n```\nno path\n```\n```tsx\ncut off")
    assert [(e["path"], e["op"]) for e in got["edits"]] == [("src/a.tsx", "write"), ("src/b.ts", "write"), ("src/c.ts", "delete")]
    assert got["elided"] and got["elision_marker"] == "// ... rest of the file unchanged" and got["malformed_blocks"] == 2
    assert edits.omission("a\n...\nb") == "..." and edits.omission("const x = [...y]\nreturn") == ""


DIFF = """diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,3 +1,3 @@
 one
-two
+2
 three
diff --git a/src/n.ts b/src/n.ts
--- /dev/null
+++ b/src/n.ts
@@ -0,0 +1 @@
+new
diff --git a/src/d.ts b/src/d.ts
--- a/src/d.ts
+++ /dev/null
@@ -1 +0,0 @@
-gone
"""


def test_diffs():
    found = edits.parse_diff(DIFF)
    assert [(f["path"], f["is_new"], f["is_delete"]) for f in found] == [("src/a.ts", False, False), ("src/n.ts", True, False), ("src/d.ts", False, True)]
    assert found[0]["hunks"] == [(["one", "two", "three"], ["one", "2", "three"])]
    again = edits.parse_search_replace(edits.diff_as_search_replace(DIFF))
    assert [(e["path"], e["op"]) for e in again["edits"]] == [("src/a.ts", "replace"), ("src/n.ts", "write"), ("src/d.ts", "delete")]
    assert "2\nthree" in edits.diff_as_whole_files(DIFF, {"src/a.ts": "one\ntwo\nthree\n"})
    with pytest.raises(FileNotFoundError):
        edits.diff_as_whole_files(DIFF, {})
    assert edits.find_diff(f"text\n```diff\n{DIFF}```\nmore") == DIFF and edits.find_diff("--git a/x b/x") == "" and edits.find_diff("see diff --git a/x b/x") == "diff --git a/x b/x\n"
    assert edits.repaired_diff("--git a/x b/x\r\n+y") == "diff --git a/x b/x\n+y\n"


def e(path, op, search="", content=""):
    return edits.edit(path, op, search, content)


@pytest.mark.parametrize("script,files,accepted,failure", [
    ([e("a", "replace", "x\n", "y\n")], {"a": "x\n"}, [0], None), ([e("a", "replace", "x\n", "y")], {"a": "x"}, [0], None), ([e("a", "replace", "x", "y")], {"a": "xx"}, [], "ambiguous_match"),
    ([e("a", "replace", "q", "y"), e("a", "write", content="z"), e("a", "replace", "z", "w")], {"a": "x"}, [1, 2], "search_not_found"), ([e("a", "delete"), e("a", "replace", "x", "y")], {"a": "x"}, [0], "file_not_found"),
    ([e("../a", "write", content="z")], {}, [], "file_not_found"), ([e("b", "delete")], {"a": "x"}, [], "file_not_found"), ([e("a", "move")], {"a": "x"}, [], "malformed_blocks"), ([], {}, [], "empty_edit"), ([e("a", "replace", "", "y")], {"a": "x"}, [], "search_not_found"),
])
def test_replay(script, files, accepted, failure):
    got = edits.replay(script, 0, files)
    assert (got["accepted"], got["first_failure"]) == (accepted, failure) and got["partial"] == bool(accepted and failure)


def test_replay_of_tables(spark, tmp_path):
    scripts = spark.createDataFrame([("c1", "s", [("a", "replace", "x", "y")], 0), ("c2", "s", [], 2)], "candidate_id string, snapshot string, edits array<struct<path:string,op:string,search:string,content:string>>, malformed_blocks int")
    sources = edits.with_mounts(spark.createDataFrame([("s", "a", "q")], "snapshot string, path string, body string"), spark.createDataFrame([("s", "a", "x")], "snapshot string, path string, body string"))
    got = {r.candidate_id: r.replay for r in edits.replay_scripts(scripts, sources).collect()}
    assert got["c1"].would_apply and got["c2"].first_failure == "malformed_blocks" and got["c2"].script_level
    kept = edits.reduced(scripts.withColumn("accepted", F.when(F.col("candidate_id") == "c1", F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))))
    assert {r.candidate_id: len(r.edits) for r in kept.collect()} == {"c1": 1, "c2": 0}
    with pytest.raises(Exception, match="sorted"):
        edits.reduced(scripts.withColumn("accepted", F.array(F.lit(5)))).collect()
    folder = tmp_path / "c9"
    folder.mkdir()
    (folder / "diff.json").write_text(json.dumps({"format": "search_replace", "edits": [{"path": "a", "op": "delete"}]}))
    row = edits.read_scripts(spark, str(tmp_path)).first()
    assert (row.candidate_id, row.edits[0].search, row.malformed_blocks) == ("c9", "", 0)
