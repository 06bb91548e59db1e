import random

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash, vantage
from graphloom.llm.components import components


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def flipped(r, x, n):
    for _ in range(n):
        x ^= 1 << r.randrange(64)
    return x


def family(r, n):
    """Random fingerprints, dense balls and long chains."""
    out = {r.getrandbits(64) for _ in range(n // 3)}
    centre = r.getrandbits(64)
    out |= {flipped(r, centre, r.randrange(9)) for _ in range(n // 3)}
    x = r.getrandbits(64)
    for _ in range(n // 3):
        x = flipped(r, x, r.choice([2, 4, 4, 5]))
        out.add(x)
    return sorted(out)


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("seed", range(4))
def test_vantage_point_tree_finds_every_component(seed, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 8)
    fps = family(random.Random(seed), 240)
    label = vantage.Forest(np.array(fps, dtype=np.uint64), 4).label.tolist()
    assert same_partition(label, brute(fps, 4))


@pytest.mark.parametrize("shard_rows", [5, 20_000])
def test_sharded_links_against_brute_force(spark, shard_rows):
    fps = family(random.Random(9), 300)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(vantage.links(frame, 4, shard_rows)).collect()}
    assert same_partition([roots.get(x, x) for x in signed], brute(fps, 4))


def test_fingerprints(spark, docs_edge):
    texts = [r.text or "" for r in docs_edge.collect()] + ["Tab\tand\x0bnew\nline É É x", "a\x85b\xa0c d e f", "w " * 3000]
    assert [simhash.fingerprint(t, 4) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_documents_against_brute_force(spark, docs_edge):
    docs = docs_edge.unionByName(docs_edge.selectExpr("doc_id + 100 doc_id", "concat(text, ' and more') text", "n_tokens", "fingerprint", "lang"))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, shard_rows=3).collect()}
    data = sorted((r.doc_id, r.text or "") for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in data]
    label = brute(fps, 4)
    for (i, _), fp, x in zip(data, fps, label, strict=True):
        assert got[i].fingerprint == f"{fp:016x}" and got[i].component_id == data[x][0]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_keep_one_loses_no_text(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (None, a, "n"), (None, "c d", "n"), (None, None, "n"), (9, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(simhash.keep_one(docs)) == sorted([(1, a, "x"), (5, b, "z"), (None, "c d", "n"), (9, "", "e")], key=str)
    assert simhash.keep_one(docs).columns == docs.columns
    same = spark.createDataFrame([(3, "q", "1"), (3, "q", "2")], "doc_id long, text string, _row string")
    assert simhash.keep_one(same).count() == 1
