"""BM25 over counted texts: odd inputs against the queries' own SQL, blocks, and how many rows a shuffle gets."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.functions import text
from graphloom.operators import lexical, rank

WORDS = "fooBar HTTPServer v2Api the cart-context x ABCdEF Zeile 12ab naïve İstanbul 300K aKb useCart2 straße product's".split()


def odd_tables(folder):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices(WORDS, k=r.randrange(0, 40)))) for i in range(120)]
    docs += [(500 + i, docs[7][1]) for i in range(30)]  # exact copies: ties
    docs += [(900, "fooBar the cart"), (900, "the cart fooBar"), (900, "fooBar fooBar x y z"), (901, None), (902, ""), (None, docs[7][1]), (None, "fooBar"), (903, "--- …")]  # one id with several rows
    items = [(i, " ".join(r.choices(WORDS, k=r.randrange(1, 9)))) for i in range(12)] + [(3, "fooBar cart"), (50, None), (51, "nothing"), (52, docs[7][1]), (None, "cart")]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("name", ["bm25_code_terms_topk", "bm25_rank_topk"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    con = odd_tables(tmp_path)
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [(r.query_id, r.doc_id, r.score, r["rank"]) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert len(want) > 50 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_code_terms_are_tokens(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("abzAZQ019 _-é\n", k=60)) for _ in range(300)] + ["", None, *WORDS]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.tokens(F.col("t")).alias("terms"))
    for row in frame.collect():
        counted = lexical.CODE_TERMS.counted(row.t.encode() if row.t is not None else None)
        assert sorted(t.decode() for t in counted.elements()) == sorted(row.terms)


def small(spark, n):
    r = random.Random(3)
    texts = [" ".join(r.choices(WORDS, k=12)) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3), spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "q int, t string")


def test_blocks_and_cut_change_nothing(spark, monkeypatch):
    docs, asked = small(spark, 200)
    args = (docs, asked, "id", F.col("t"), "q", F.col("t"))
    whole = rank.bm25(*args, digits=6)
    want = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in rank.top_k(whole, 4).collect()}
    assert len(want) > 40
    monkeypatch.setattr(lexical, "PAIRS", 50)
    for block in (5, 1000):
        assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in rank.bm25(*args, k=4, digits=6, block=block).collect()} == want


def shuffled(df):
    """Rows that each exchange of a frame's plan was given."""
    df.collect()
    rows, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
        elif "QueryStage" in name:
            left.append(node.plan())
        else:
            if name == "Exchange":
                rows.append(node.metrics().get("shuffleRecordsWritten").get().value())
            left += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_code_words_are_taken_apart_once(spark, monkeypatch):
    docs, asked = small(spark, 300)
    plan = rank.bm25(docs, asked, "id", F.col("t"), "q", F.col("t"))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "lambda" not in plan  # Spark takes each word of each text apart up to three times
    known, seen = lexical._Known(lexical.CODE_TERMS, {b"foo": 0}), []
    take = lexical._code_terms
    object.__setattr__(known, "terms", lexical.Terms(False, lambda word: seen.append(word) or take(word)))
    assert [known[w] for w in [b"fooBar", b"Zeile"] * 3] == [(3, [0]), (1, [])] * 3 and seen == [b"fooBar", b"Zeile"]


def test_pairs_are_not_shuffled(spark):
    docs, asked = small(spark, 3000)
    args = (docs, asked, "id", F.col("t"), "q", F.col("t"))
    pairs = rank.bm25(*args)
    assert shuffled(pairs) == [] and pairs.count() > 5000
    for query in (lexical.CODE_TERMS, lexical.PLAIN_TERMS):
        best = rank.bm25(*args, query, k=3, digits=6)
        assert sum(shuffled(best)) <= 3 * 4 * len(WORDS)  # of each task its best
