import random

import numpy as np
import pytest

from graphloom.llm import similar, simhash


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


def corpus(seed, families=40, alone=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 7)))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(r.randrange(120, 400))]
        texts += [" ".join(edited(r, base, r.randrange(0, 1 + len(base) // 60))) for _ in range(4)]
    return texts + [" ".join(word() for _ in range(r.randrange(60, 300))) for _ in range(alone)] + [None, "", "short one", "short one"]


def brute(texts, words=5, least=0.8):
    sets = [similar.shingles(t or "", words) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                links.append((i, j))
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], links


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed):
    texts = corpus(seed)
    want, links = brute(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, d string")
    got = {i: i for i in range(len(texts))} | {r.doc_id: r.group_id for r in similar.similar_groups(docs).collect()}
    caught = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 100 and caught >= 0.95 * len(links)
    strangers = [(i, j) for i in range(len(texts)) for j in range(i) if got[i] == got[j] and want[i] != want[j]]
    loose, _ = brute(texts, least=0.7)
    assert all(loose[i] == loose[j] for i, j in strangers)  # what is merged beyond the threshold is close to it


def test_one_of_each_group_stays(spark):
    texts = corpus(3, families=10, alone=20)
    docs = spark.createDataFrame([(i, t, "de", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    groups = {i: i for i in range(len(texts))} | {r.doc_id: r.group_id for r in similar.similar_groups(docs).collect()}
    assert len(kept) <= len(set(groups.values())) and all(i in kept for i in range(40, 60)) and 42 in kept
    assert simhash.keep_one(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs)
    assert sorted(r.doc_id for r in simhash.keep_one(twice).collect()) == sorted(kept)


def test_buckets_of_many_copies_stay_linear():
    r = np.random.default_rng(0)
    hi, lo = np.full(5000, 7, np.uint64) ^ (np.uint64(1) << r.integers(0, 60, 5000).astype(np.uint64)), np.zeros(5000, np.uint64)
    links = similar.bucket_links(np.arange(5000), hi, lo, 30)
    assert sum(len(u) for u, _, _ in links) == 4999


def test_limit():
    assert 128 * similar.differing(0.8) < similar.limit(0.8) <= 32
    assert similar.sampling(1000, 0.8)[0] == 12 and similar.sampling(1 << 26, 0.8)[0] == 20
