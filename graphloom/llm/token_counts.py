"""Token counts: pieces counted once per distinct pre-token, joined to each document's pre-token frequencies and summed.

Texts are split into pre-tokens in blocks of documents. A block sends its distinct pre-tokens to the buckets of their hashes and its
documents' frequencies to itself. A bucket counts the pieces of each pre-token the first time it meets it and answers every block with one
number a pre-token; the block joins the answers to its frequencies. A pre-token that a third of all documents have is one entry a block,
so no key is hot, and no token id is ever made in Python: the library is asked for lengths alone.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import arrow, rows, texts_of, written
from graphloom.llm.library_tokens import PLAIN_TEXT, tokenizer

FIELDS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}
#: The split pattern of byte-level pre-tokenizers on plain texts, where all pattern engines agree on the classes.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")
#: Characters and documents of a block, and buckets at least.
BLOCK, BLOCK_DOCS, BUCKETS = 1 << 25, 1 << 16, 64
#: Distinct pre-tokens that a bucket remembers; one that it has forgotten is counted again, with the same result.
REMEMBERED = 1 << 20
PARTS = {"block": pa.int64(), "bucket": pa.int32(), "data": pa.binary()}
PARTS_DDL = "block long, bucket int, data binary"


@lru_cache(maxsize=4)
def splitter(path: str):
    """A function from a text to its pre-tokens, special strings among them. A tokenizer whose split is not the byte-level one takes every
    text as one pre-token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own, split = tokenizer(path), spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        return lambda text: [text] if text else []
    specials = [t["content"] for t in added]
    apart = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def plain(text: str) -> list[str]:
        if PLAIN_TEXT.fullmatch(text):
            return PLAIN_SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(text)]

    def cut(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return plain(text)
        return [x for i, part in enumerate(apart.split(text)) for x in ([part] if i % 2 else plain(part))]

    return cut


def piece_counts(path: str, pretokens: list[str]) -> list[int]:
    """The number of pieces of each pre-token; ids stay in the library."""
    own = tokenizer(path)
    return [len(e) for at in range(0, len(pretokens), 4096) for e in own.encode_batch_fast(pretokens[at : at + 4096], add_special_tokens=False)]


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join([np.array([len(a.tobytes()) for a in arrays], "<u8").tobytes(), *(a.tobytes() for a in arrays)]), 1)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zlib.decompress(data)
    sizes, at, out = np.frombuffer(raw, "<u8", len(kinds)).tolist(), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


class Block:
    """Documents and the frequencies of their pre-tokens, numbered as they come."""

    def __init__(self):
        self.ids: defaultdict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.docs: list[tuple] = []
        self.found: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: str, pretokens: list[str]) -> None:
        ids, times = np.unique(np.fromiter(map(self.ids.__getitem__, pretokens), np.int64, len(pretokens)), return_counts=True)
        self.docs.append((doc_id or 0, doc_id is not None, len(text.encode()), len(ids)))
        self.found.append(ids.astype("<u4"))
        self.times.append(times.astype("<u4"))
        self.size += len(text)

    def parts(self, block: int, buckets: int) -> list[tuple[int, int, bytes]]:
        """What goes to the block itself (bucket -1), and the distinct pre-tokens by bucket. Pre-tokens are numbered anew, by bucket."""
        raws = [x.encode() for x in self.ids]
        of = np.fromiter((zlib.crc32(x) % buckets for x in raws), np.int64, len(raws))
        order = np.argsort(of, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc_id, known, n_bytes, n = (np.array(c, "<i8") for c in zip(*self.docs, strict=True))
        found = place[np.concatenate([*self.found, np.empty(0, "<u4")]).astype(np.int64)].astype("<u4")
        out = [(block, -1, _pack(doc_id, known, n_bytes, n, found, np.concatenate([*self.times, np.empty(0, "<u4")]).astype("<u4")))]
        bounds = np.searchsorted(of[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = [raws[i] for i in order[bounds[b] : bounds[b + 1]].tolist()]
            out.append((block, b, _pack(np.array([len(x) for x in own], "<u4"), np.frombuffer(b"".join(own), np.uint8))))
        return out


def frequencies(texts: DataFrame, path: str, buckets: int, block_chars: int = BLOCK) -> DataFrame:
    """``block, bucket, data``: what every block sends (see ``Block.parts``)."""

    def run(batches):
        cut, part, turn, block = splitter(path), TaskContext.get().partitionId(), 0, Block()
        for doc_ids, block_texts in rows(batches, "doc_id", "text"):
            for doc_id, text in zip(doc_ids, block_texts, strict=True):
                block.add(doc_id, text, cut(text))
                if block.size >= block_chars or len(block.docs) >= BLOCK_DOCS:
                    yield arrow(PARTS, zip(*block.parts(part << 32 | turn, buckets), strict=True))
                    turn, block = turn + 1, Block()
        if block.docs:
            yield arrow(PARTS, zip(*block.parts(part << 32 | turn, buckets), strict=True))

    return texts.mapInArrow(run, PARTS_DDL)


def answers(sent: DataFrame, path: str) -> DataFrame:
    """``block, bucket, data``: the pieces of each pre-token that a block sent to a bucket, in its order."""

    def run(batches):
        bucket, known = None, {}
        for batch in batches:
            for block, own, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != bucket or len(known) > REMEMBERED:
                    bucket, known = own, {}
                lengths, raw = _unpack(data, "<u4", "u1")
                raw, stops = raw.tobytes(), lengths.astype(np.int64).cumsum().tolist()
                pretokens = [raw[a:b].decode() for a, b in zip([0, *stops], stops)]  # noqa: B905
                new = [x for x in pretokens if x not in known]
                known.update(zip(new, piece_counts(path, new), strict=True))
                yield arrow(PARTS, ([block], [own], [_pack(np.array([known[x] for x in pretokens], "<u4"))]))

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PARTS_DDL)


def joined(parts: DataFrame, limit: int) -> DataFrame:
    """Counts by document, from a block's own frequencies and the answers to it."""

    def close(data: bytes, got: list[np.ndarray]):
        doc_id, known, n_bytes, n, found, times = _unpack(data, "<i8", "<i8", "<i8", "<i8", "<u4", "<u4")
        pieces = np.concatenate([*got, np.empty(0, "<u4")]).astype(np.int64)
        ends = np.r_[0, (pieces[found.astype(np.int64)] * times).cumsum()]
        stops = n.cumsum()
        total = ends[stops] - ends[stops - n]
        ids = pa.array(doc_id, pa.int64(), mask=known == 0)
        return pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(total, pa.int64()), pa.array(total > limit)], list(FIELDS))

    def run(batches):
        at, data, got = None, b"", []
        for batch in batches:
            for block, bucket, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket < 0:
                    if at is not None:
                        yield close(data, got)
                    at, data, got = block, raw, []
                else:
                    got.append(_unpack(raw, "<u4")[0])
        if at is not None:
            yield close(data, got)

    return parts.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, without materialising ids.

    Null texts count as empty (0 bytes, 0 tokens, not over); null and repeated doc_ids stay, a row each; an empty table gives an empty one;
    other columns are ignored; a text may be longer than a block, which then holds it alone. The frequencies are written once, so a
    block's documents and the answers to it always belong together."""
    texts = texts_of(docs, id_col, text_col)
    # Every block has a part for every bucket, so their number grows with the root of the partitions that the session sets for its data.
    buckets = max(BUCKETS, 8 * isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sent = written(frequencies(texts, tokenizer_path, buckets, block_chars))
    return joined(sent.where("bucket < 0").unionByName(answers(sent.where("bucket >= 0"), tokenizer_path)), limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
