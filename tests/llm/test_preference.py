import duckdb
from pyspark.sql import functions as F

from graphloom.llm import preference


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def mask(turns):
    return ",".join(f"{len(r) + 5}:0,{len(t) + 8}:1" if r == "assistant" else f"{len(r) + len(t) + 13}:0" for r, t in turns)


CASES = {
    1: ([("user", "hi"), ("assistant", "a"), ("user", "x")], [("user", "hi"), ("assistant", "b")]),
    2: ([("user", "same")], [("user", "same")]),
    3: ([("user", "é"), ("assistant", "one")], [("system", "é"), ("assistant", "one")]),
    4: ([("user", "q"), ("assistant", "long")], [("user", "q")]),
    5: ([], [("user", "only rejected")]),
}


def test_against_brute_force(spark):
    kind = "array<struct<turn:long,role:string,text:string>>"
    rows = [(i, [(k, *t) for k, t in enumerate(a)] or None, [(k, *t) for k, t in enumerate(b)]) for i, (a, b) in CASES.items()]
    got = {r.pair_id: r for r in preference.format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    for i, (a, b) in CASES.items():
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        r = got[i]
        assert (r.n_shared, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) == (n, render(a[:n]), render(a[n:]), render(b[n:]), mask(a[n:]), mask(b[n:]))


def test_masks_cover_the_text(spark):
    pairs = preference.op8_preference(spark, "/root/testdata/sf0.001").collect()
    for r in pairs:
        for text, runs in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            at = 0
            for run in filter(None, runs.split(",")):
                n, trained = map(int, run.split(":"))
                if trained:
                    assert text[at - 14 : at] == "<|assistant|>\n" and text[at : at + n].endswith("<|end|>\n")
                at += n
            assert at == len(text)


def test_edges_and_sql_agree(spark):
    turns = [(1, 0, "user", None, 1), (1, 1, None, "x", 1), (1, 1, None, "x", 1), (None, 0, "assistant", "lost", 1), (2, None, "assistant", "ab é 😀", 1), (2, 5, "assistant", "", 1), (3, 1, "user", "w " * 50_000, 1)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns int")
    whole = preference.conversations(frame)
    got = preference.format_pairs(whole.withColumnRenamed("turns", "chosen").withColumn("rejected", preference.cut_short(F.col("chosen"))))
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    names = ["n_shared", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    want = con.sql(preference.OP8_SQL).fetchall()
    assert sorted([tuple(r[n] for n in names) for r in got.collect()]) == sorted(tuple(r[1:]) for r in want)
    assert preference.format_pairs(got.limit(0).selectExpr("pair_id", "array(struct(1L turn, '' role, '' text)) chosen", "array(struct(1L turn, '' role, '' text)) rejected")).count() == 0
