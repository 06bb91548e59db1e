import hashlib
from array import array
from functools import lru_cache

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, library_tokens, token_counts

MULTI, FIFTY = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = st.sampled_from(list("abth'sl 19.$ \n\t\r\x1c\x85\xa0　éß中あ😀") + ["  ", " \n ", "the", " the", "<|endoftext|>"])


# Made once here: a worker's tables give way to those of another operator, and these tests use several by turns.
@lru_cache
def own():
    return byte_bpe.load(MULTI, P.PATTERN)


@lru_cache
def chunk_ids():
    return library_tokens.chunk_ids(FIFTY)


@lru_cache
def document_ids():
    return library_tokens.document_ids(FIFTY)


@lru_cache
def library():
    return Tokenizer.from_file(FIFTY)


@lru_cache
def packed():
    return library_tokens._packed(FIFTY)


@lru_cache
def ranked():
    bpe, _ = own()
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@pytest.fixture(scope="module")
def tik():
    return ranked()


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_ids_match_the_libraries(text):
    bpe, codes = own()
    enc = ranked()
    ids = array("I", codes.encode(text)).tolist()
    assert ids == enc.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()
    fifty = array("I", chunk_ids().encode(text)).tolist()
    assert fifty == library().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "thethethe" * 1500, "$" * 3000, "ñ" * 2000, "supercalifragilistic" * 300])
def test_long_pretokens(text, tik):
    bpe, codes = own()
    assert array("I", codes.encode(text)).tolist() == tik.encode_ordinary(text)
    assert not bpe.queue.top and not bpe.queue.buckets and not any(bpe.queue.low)


@pytest.mark.parametrize("text", [" <|endoftext|>", "<|endoftext|>", " a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|", " "])
def test_special_strings(text):
    want = library().encode(text, add_special_tokens=False).ids
    assert array("I", chunk_ids().encode(text)).tolist() == want


def test_bounded_dictionary_forgets_without_changing_ids():
    bpe, _ = own()
    small = byte_bpe.ChunkCodes(bpe.encode_many, limit=3)
    text = "one two three four five two one six"
    assert small.encode(text) == small.encode(text) == bpe.encode_many([text])[0]


def test_documents(spark, docs_edge):
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs_edge, MULTI, P.PATTERN).collect()}
    for r in docs_edge.collect():
        text = r.text or ""
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    lib = library()
    for r in token_counts.count_tokens(docs_edge, FIFTY).collect():
        text = next(x.text or "" for x in docs_edge.collect() if x.doc_id == r.doc_id)
        assert r.n_tokens == len(lib.encode(text, add_special_tokens=False).ids)
        assert r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 512)
    encoded = byte_bpe.encode_documents(docs_edge, MULTI, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes).decode() for r in byte_bpe.decode_documents(encoded, MULTI, P.PATTERN).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs_edge.collect()}


def test_empty_table(spark, docs_edge):
    none = docs_edge.limit(0)
    assert byte_bpe.round_trip(none, MULTI, P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, FIFTY).count() == 0


def test_rank_encoder_agrees_with_the_library_on_every_word_of_a_corpus():
    import pyarrow.parquet as pq

    words = set()
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text").to_pylist():
        words.update((text or "").split(" "))
    words = sorted(words)
    codes = library_tokens._packed(FIFTY)([" " + w for w in words])
    lib = library().encode_batch_fast([" " + w for w in words], add_special_tokens=False)
    assert all(array("I", c).tolist() == e.ids for c, e in zip(codes, lib, strict=True)) and len(words) > 100_000


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sZ9.$éß", " ", "  ", "\n", "\n\n", " \n", "the", " the", "'ll", "<|endoftext|>"]), max_size=30).map("".join))
def test_whole_plain_texts_agree(text):
    want = library().encode(text, add_special_tokens=False).ids
    assert array("I", document_ids()([text])[0]).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=255), min_size=1, max_size=30))
def test_rank_encoder_agrees_on_any_plain_chunk(word):
    lib = library()
    assert array("I", packed()([" " + word])[0]).tolist() == lib.encode(" " + word, add_special_tokens=False).ids
