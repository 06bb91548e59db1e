import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import pii, quality, similar


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def components(ids, linked):
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if linked(i, j):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(docs, labels):
    """The four stages in plain Python: texts by id after each of the first three."""
    known = sorted({i: q for i, q in labels if q is not None and zlib.crc32(str(i).encode()) % 4 != 2 and i in docs}.items())
    model = quality.fit([quality.indicators(docs[i]) for i, _ in known], np.array([q for _, q in known])) if known else quality.neutral()
    first = {i: t for i, t in docs.items() if model.score(t) >= 0.7}
    sets = {i: similar.shingles(t, 5) for i, t in first.items()}
    group = components(sorted(first), lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    second = {i: t for i, t in first.items() if group[i] == i}
    field = pii.fit(sorted(x for t in second.values() for x in pii.sample_rows(t)))
    return first, second, {i: pii.masked(t, field.spans(t)[1]) for i, t in second.items()}


def test_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in frame.collect()}
    docs[900], docs[901], docs[902] = docs[3], docs[5] + " and call +1 (555) 123-4567 or mail a.b@example.com", "$$$ !!! $$$ !!! $$$ !!!"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/in/labels.parquet")
    wants = brute(docs, [(r.doc_id, r.quality) for r in labels.collect()])
    got = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], wants, strict=True):
        stage(spark, got, f"{tmp_path}/in").write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        assert got.columns == COLUMNS
        assert {r.doc_id: r.text for r in got.collect()} == want, name
    assert 900 not in wants[1] and 0 < len(wants[2]) < len(docs) and all(r.n_chars == len(r.text) for r in got.collect())
    assert not any(pii.base_spans(t) for t in wants[2].values())
    lib, rows = Tokenizer.from_file(P.path("byte_bpe_50k.json")), corpus_pipeline.run(spark, f"{tmp_path}/in").collect()
    tokens, places = defaultdict(int), defaultdict(list)
    for r in rows:
        tokens[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert tokens == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in wants[2].items()}
    for row in places.values():
        end = 0
        for offset, length in sorted(row):
            assert offset == end
            end += length
        assert end <= 2048


@pytest.mark.parametrize("rows", [0, 1])
def test_edges(spark, docs_edge, tmp_path, rows):
    """Nulls, empty and long texts, repeated rows and columns whose names clash; without labels every text scores one half and goes, so the later
    stages are also run on the documents themselves."""
    sf = str(tmp_path / "in")
    docs = docs_edge.selectExpr("doc_id", "text", "lang", "'s' source", "cast(n_tokens as long) n_chars", "fingerprint", "n_tokens", "doc_id score")
    docs = docs.unionByName(docs) if rows else docs.limit(0)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    got = docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, got, sf).write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or got.columns == docs.columns
    if rows:
        texts = {r.doc_id: r.text for r in docs_edge.collect()}
        kept = {r.doc_id for r in got.collect()}
        assert {0, 3, 4, 7, 9} <= kept and not {1, 2, 5, 8} & kept and texts[4] == texts[5]
    else:
        assert got.count() == 0
