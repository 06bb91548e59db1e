"""The registered queries that SQL cannot express, each over its whole table against plain Python."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from graphloom.llm import audio, html_text, packing, pii, quality, token_counts
from test_audio import brute as best_alignment
from test_pii import plain_base

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_op1(spark):
    got = {r.vec_id: r for r in audio.op1_audio(spark, SF).collect()}
    rows = table("embeddings")
    prints = {r["vec_id"]: audio.fingerprint(audio.decode_vector(np.float32(r["embedding"]).astype(float).tolist())) for r in rows}
    classes, copies = {}, {}
    for i in sorted(prints):
        own = classes.setdefault(prints[i].tobytes(), i)
        copies[own] = copies.get(own, 0) + 1
    asked = [i for i in prints if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    for i in asked:
        own = classes[prints[i].tobytes()]
        # An offset without an equal integer has no vote, so recordings without a common one need no look.
        near = [c for c in copies if c != own and len(np.intersect1d(prints[c], prints[own]))]
        found = {c: f for c in near if (f := best_alignment(prints[own], prints[c]))}
        assert (got[i].class_id, got[i].n_copies, got[i].n_classes, got[i].n_matches) == (own, copies[own] - 1, len(found), sum(copies[c] for c in found))
        if found:
            c = min(found, key=lambda c: (found[c][3] / found[c][2], c))
            assert (got[i].best_id, got[i].best_offset, got[i].best_bits, got[i].best_bit_errors) == (c, found[c][0], found[c][2], found[c][3])


def test_op4(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op4_token_counts(spark, SF).collect()}
    want = {}
    for r in table("documents"):
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 512)
    assert got == want


@pytest.mark.parametrize("block_chars", [1, 3000, 1 << 25])
def test_op4_counts_do_not_depend_on_blocks(spark, docs_edge, block_chars):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    docs = docs_edge.unionByName(docs_edge.selectExpr("cast(null as long) doc_id", "text", "n_tokens", "fingerprint", "lang"))
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, path, block_chars=block_chars).collect()), key=str)
    assert got == sorted(((r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)


def test_op4_keeps_a_number_a_distinct_pretoken():
    block, cut = token_counts.Block(), token_counts.splitter(P.path("byte_bpe_50k.json"))
    for i, text in enumerate(["the words and the words", "the words"]):
        block.add(i, text, cut(text))
    assert sorted(block.ids) == sorted({"the", " words", " and", " the"})
    sent = block.parts(7, 3)
    assert [x[:2] for x in sent][0] == (7, -1) and {b for _, b, _ in sent} <= {-1, 0, 1, 2}


def test_op6(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    field = pii.fit(sorted(x for t in docs.values() for x in pii.sample_rows(t)))
    got = {r.doc_id: r for r in pii.op6_pii(spark, SF).collect()}
    assert sorted(got) == sorted(docs)
    for i, text in docs.items():
        base = sorted(plain_base(text), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        kinds = [s[0] for s in base]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(kinds.count(k) for k in pii.KINDS)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        every = [tuple(s.split(":")) for s in got[i].spans.split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(every)
        assert [(k, int(a), int(b)) for k, a, b in every] == field.spans(text)[1]


def test_op7(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    known = {}
    for r in table("labels"):
        if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in docs:
            known[r["doc_id"]] = min(known.get(r["doc_id"], 1), r["quality"])
    model = quality.fit([quality.indicators(docs[i]) for i in sorted(known)], np.array([known[i] for i in sorted(known)]))
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.op7_quality(spark, SF).collect()}
    want = {i: model.score(t) for i, t in docs.items()}
    assert got == {i: (zlib.crc32(str(i).encode()) % 4 == 2, s, int(s >= 0.7)) for i, s in want.items()}


def test_op9(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.op9_html_text(spark, SF).collect()}
    want = {}
    for r in table("pages"):
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div|ul|li|br)\b[^>]*>", article)]
        text = " ".join(x for x in blocks if x)
        want[r["page_id"]] = (r["url"], text, len(text))
    assert got == want


def test_op3(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens, places = {}, {}
    for r in packing.op3_best_fit_packing(spark, SF).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert tokens == {r["doc_id"]: len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in table("documents")}
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= 1.02 * -(-sum(tokens.values()) // 2048) + 1
