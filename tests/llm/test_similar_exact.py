import random

import numpy as np
import pytest

from graphloom.llm import similar
from test_similar import brute


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def replaced(r, base, at, n):
    """``base`` with n words of its own from ``at`` on: n + 4 of its shingles differ."""
    return base[:at] + words(r, n) + base[at + n :]


@pytest.fixture(scope="module")
def solved(spark):
    """Texts by part of the corpus, and what the stage and all pairs make of them."""
    r = random.Random(11)
    parts, base = {}, words(r, 400)
    parts["template"] = [replaced(r, base, 100, r.randrange(46, 71)) for _ in range(250)]
    parts["template"] += [replaced(r, t, 300, 8) for t in parts["template"][::10]]
    base = words(r, 400)
    parts["family"] = [replaced(r, base, 100, 52) for _ in range(250)]
    singles = [words(r, 400) for _ in range(200)]
    parts["edge"] = singles + [replaced(r, t, 50, (40, 36, 32, 28)[i % 4]) for i, t in enumerate(singles)]
    texts, span = [], {}
    for name, own in parts.items():
        span[name] = range(len(texts), len(texts) + len(own))
        texts += [" ".join(t) for t in own]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: i for i in range(len(texts))} | {x.doc_id: x.group_id for x in similar.similar_groups(docs).collect()}
    want, links = brute(texts)
    return span, got, want, links


def test_true_pairs_among_pages_of_a_template(solved):
    span, got, want, links = solved
    assert sum(i in span["template"] for i, _ in links) == 25
    assert all(got[i] == want[i] for i in span["template"])


def test_no_pair_at_the_threshold_is_missed(solved):
    span, got, want, links = solved
    assert sum(i in span["edge"] for i, _ in links) == 200
    assert all(got[i] == want[i] for i in span["edge"])


def test_different_texts_of_a_family_stay(solved):
    span, got, _, links = solved
    assert not any(i in span["family"] for i, _ in links)
    assert all(got[i] == i for i in span["family"])


def test_every_pair_between_two_groups_is_tried(spark):
    r = random.Random(12)
    near, far = words(r, 100), words(r, 100)
    texts = spark.createDataFrame([(1, near), (2, far), (3, replaced(r, near, 0, 13)), (4, replaced(r, far, 0, 6))], "row long, t array<string>").selectExpr("row", "array_join(t, ' ') text")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "row long, root long")
    firsts = similar.prefixes(texts, np.zeros(similar.SLOTS, np.uint32), 5, 0.8).join(roots, "row")
    met = similar.met_elements(firsts, similar.shared_elements(firsts))
    pairs = similar.pairs_between(met, 0.8)
    assert (4, 2) in {tuple(x) for x in pairs.collect()}
    assert [tuple(x) for x in similar.verified(texts, similar.possible(pairs, firsts, 0.8), 5, 0.8).collect()] == [(4, 2)]
