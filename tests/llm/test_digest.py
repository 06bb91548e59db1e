import hashlib

import pytest

from graphloom.llm import digest


def test_canonical_folds_form_case_and_space():
    alike = ["Straße  und\tﬁ", "STRASSE und fi ", "strasse und\nfi", "Straẞe und fi"]
    assert len({digest.canonical(x) for x in alike}) == 1
    assert digest.canonical("é") == digest.canonical("é") != digest.canonical("e")
    assert digest.canonical("A b") == digest.canonical(" a  B") != digest.canonical("ab")


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_against_brute_force(spark, docs_edge, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in digest.compare_with_next(docs_edge).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    data = sorted(((r.doc_id, r.text or "") for r in docs_edge.collect()), reverse=True)
    assert len(got) == len(data)
    for i, (doc_id, text) in enumerate(data):
        following = data[(i + 1) % len(data)][1]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(digest.canonical(text) == digest.canonical(edited)) == float(r.fingerprint == r.edited_fingerprint)
        assert r.near_next == float(digest.canonical(text) == digest.canonical(following))


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_groups(spark, docs_edge, broadcast_bytes):
    got = {r.doc_id: r.group_id for r in digest.group_ids(docs_edge, digest.digests(docs_edge), broadcast_bytes=broadcast_bytes).collect()}
    data = [(r.doc_id, digest.canonical(r.text or "")) for r in docs_edge.collect()]
    assert got == {i: min(j for j, y in data if x == y) for i, x in data}


def test_colliding_digests_do_not_join_texts(spark, docs_edge):
    weak = lambda form: str(len(form) % 2)
    found = digest.digests(docs_edge, digest=weak)
    got = {r.doc_id: r.group_id for r in digest.group_ids(docs_edge, found, digest=weak).collect()}
    data = [(r.doc_id, digest.canonical(r.text or "")) for r in docs_edge.collect()]
    assert got == {i: min(j for j, y in data if x == y) for i, x in data}


def test_empty_and_single(spark, docs_edge):
    assert digest.compare_with_next(docs_edge.limit(0)).count() == 0
    one = digest.compare_with_next(docs_edge.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = docs_edge.where("doc_id = 4").unionByName(docs_edge.where("doc_id = 4"))
    assert digest.compare_with_next(twice).count() == 2
