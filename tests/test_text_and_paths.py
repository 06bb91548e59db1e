import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import resolve


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x"))
    return [r.x for r in sorted(rows.collect(), key=lambda r: r.i)]


def test_terms(spark):
    cases = {
        "decreaseProductQuantity": ["decreaseproductquantity", "decrease", "product", "quantity"],
        "HTTPServer cart-context": ["httpserver", "http", "server", "cart", "context"],
        "Fix the bug in const return": ["fix", "bug", "const", "return"],
        "the product's price is $0.00 in v2Api": ["product", "price", "00", "v2api", "api"],
        "": [], None: [],
    }
    assert column(spark, list(cases), text.tokens) == list(cases.values())


def test_estimates_and_counts(spark):
    texts = ["", None, "one", "a b c", " x\t\ny ", "w " * 1000]
    assert column(spark, texts, text.token_estimate) == [int(len((t or "").split()) * 1.3) for t in texts]
    assert column(spark, ["aaaa", "abab", "", "b"], lambda c: text.occurrences(c, F.lit("aa"))) == [2, 0, 0, 0]
    assert column(spark, ["x"], lambda c: text.occurrences(c, F.lit(""))) == [0]


def test_literals_and_names(spark):
    good = ["1", "-2.5", "'a'", '"b"', "true", "null", "undefined", "[]", "{}", " 3 "]
    assert all(column(spark, good, text.is_literal)) and not any(column(spark, ["", None, "foo()", "[1]", "'a' + 'b'"], text.is_literal))
    assert column(spark, ["useCart", "use", "user", "useÉtat", "usecart", None], text.is_hook_name) == [True, False, False, True, False, False]


def test_small_functions(spark):
    assert column(spark, ["x # cause: LLM", "none", None], text.cause_tag) == ["llm", None, None]
    assert column(spark, ["P1__kg:n1", "_x"], text.container_name) == ["P1__kg_n1", "c__x"]
    assert column(spark, [["a/b/Cart.test.tsx", "x.test.js"]], text.test_pattern, "array<string>") == ["Cart|x"]
    assert column(spark, ["openrouter/q/w", "anthropic/c", "claude-x", "bare", "google/g"], text.model_provider) == ["openrouter", "anthropic", "anthropic", "anthropic", "google"]
    assert column(spark, ["#### A (`src/a.tsx`)\n**B** (`b`)\n#### A (`src/a.tsx`)"], text.shown_files) == [["src/a.tsx"]]


def plain_normal(path):
    out = []
    for part in path.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in (".", ""):
            out.append(part)
    return "/".join(out)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "..", ".", "c.d"]), min_size=1, max_size=7).map("/".join), min_size=1, max_size=30))
def test_normal_paths(spark, cases):
    assert column(spark, cases, paths.normal) == [plain_normal(c) for c in cases]


def test_imports(spark):
    rows = [("./B", "src/a/A.tsx"), ("../x/B", "src/a/A.tsx"), ("@res/img", "a.ts"), ("@/lib", "a.ts"), ("@other/lib", "a.ts"), ("models", "a.ts"), ("/abs", "a.ts"), ("", "a.ts"), ("./B", "A.tsx")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, f string")
    aliases = F.create_map(F.lit("@"), F.lit("src"), F.lit("@res"), F.lit("src/resources"))
    got = [r.x for r in df.select("i", paths.import_base(F.col("s"), F.col("f"), aliases, F.lit("src")).alias("x")).orderBy("i").collect()]
    assert got == ["src/a/B", "src/x/B", "src/resources/img", "src/lib", None, "src/models", None, None, "B"]
    first = df.limit(1).select(paths.candidates(F.lit("p")).alias("c")).first().c
    assert first == ["p.jsx", "p.js", "p.tsx", "p.ts", "p/index.jsx", "p/index.js", "p/index.tsx", "p/index.ts"]


def test_escapes_and_prefixes(spark):
    assert column(spark, ["a/b", "../a", "a/../..", "/etc", "a/../b"], paths.escapes) == [False, True, True, True, False]
    assert column(spark, ["src", "src/a", "srcs/a"], lambda c: paths.under(c, "src")) == [True, True, False]
    assert column(spark, ["a/b\\c"], paths.flattened) == ["a_b_c"]


@pytest.mark.parametrize("seed", range(3))
def test_longest_prefix_against_a_loop(spark, seed):
    import random

    r = random.Random(seed)
    words = ["/".join(r.choices("abc", k=r.randrange(1, 5))) for _ in range(60)]
    prefixes = {"/".join(r.choices("abc", k=r.randrange(1, 4))) for _ in range(8)}
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, v string")
    table = spark.createDataFrame([(p, p.upper()) for p in prefixes], "prefix string, target string")
    for row in resolve.longest_prefix(df, "v", table).collect():
        hits = [p for p in prefixes if row.v == p or row.v.startswith(p + "/")]
        assert row.prefix == max(hits, key=len, default=None)


def test_contained_specs(spark):
    texts = ["x alpha beta  gamma delta end", "alpha\nbeta gamma delta end", "prealpha beta  gamma delta endpost", "tiny here", None, ""]
    specs = ["alpha beta  gamma delta end", "tiny", "absent words in none of them", None, ""]
    r = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    s = spark.createDataFrame(list(enumerate(specs)), "j int, s string")
    got = {(x.i, x.j) for x in resolve.contained_specs(r, s, "t", "s", "i", "j").collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, x in enumerate(specs) if t and x and x in t}


def test_globs():
    from graphloom.sources.files import glob_pattern

    assert re.fullmatch(glob_pattern("*.test.*"), "a.test.ts") and not re.fullmatch(glob_pattern("*.d.ts"), "adxts") and re.fullmatch(glob_pattern(".*rc.*"), ".eslintrc.js")
