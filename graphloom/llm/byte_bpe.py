"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.chunks import ChunkCodes
from graphloom.llm.common import arrow, rows, table, texts_of


#: Bits of a word of the bitmap. Integers are not limited to a machine word here, and two levels cost fewer steps than three.
WORD = 256
BIT = [1 << i for i in range(WORD)]


class RankQueue:
    """Positions by merge rank; the lowest rank that holds any is found by find-first-set in a top word, then in a word below it.

    Each rank's bucket is a small heap, so equal ranks come out from left to right. ``top`` tells whether anything is held.
    """

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // WORD + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            high = rank >> 8
            self.low[high] |= BIT[rank & 255]
            self.top |= 1 << high
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; the queue must hold something."""
        top = self.top
        high = (top & -top).bit_length() - 1
        word = self.low[high]
        rank = (high << 8) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        word &= word - 1
        self.low[high] = word
        if not word:
            self.top = top & (top - 1)
        return rank, bucket[0]


class ByteBPE:
    """Encoder and decoder for a table of token bytes to rank, without special tokens.

    A text splits by ``pattern``; each match is encoded by itself. Ids equal ranks. ``encode_many`` accepts any strings:
    an empty one gives no ids. Work per match is O(n log n) in its bytes, however long.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.find = regex.compile(pattern).findall
        size = max(ranks.values(), default=0) + 1
        self.queue = RankQueue(size)
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks.get(bytes([x]), -1) for x in range(256)]
        self.double = [ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)]
        self.pieces: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank_of, longest, double = len(piece), self.ranks.get, self.longest, self.double
        queue = self.queue
        push, pop = queue.push, queue.pop
        ids = [self.single[x] for x in piece]
        after = list(range(1, n + 1))  # start of the next token
        before = list(range(-1, n - 1))
        # The rank at which the token at a position merges with the next one. Queue entries that differ are stale.
        due = [double[x << 8 | y] for x, y in zip(piece, piece[1:])]  # noqa: B905
        due.append(-1)
        for i, rank in enumerate(due):
            if rank >= 0:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if due[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            ids[i] = rank
            due[gone] = -1
            if end < n:
                before[end] = i
                stop = after[end]
                new = rank_of(piece[i:stop], -1) if stop - i <= longest else -1
                due[i] = new
                if new >= 0:
                    push(new, i)
            else:
                due[i] = -1
            left = before[i]
            if left >= 0:
                new = rank_of(piece[left:end], -1) if end - left <= longest else -1
                due[left] = new
                if new >= 0:
                    push(new, left)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Matches seen before are looked up, in a table of two generations that bounds memory."""
        out = []
        for text in texts:
            codes = []
            for match in self.find(text):
                code = self.pieces.get(match)
                if code is None:
                    code = self.earlier.get(match) or array("I", self.merge(match.encode())).tobytes()
                    if len(match) <= 64:
                        if len(self.pieces) >= 700_000:
                            self.earlier, self.pieces = self.pieces, {}
                        self.pieces[match] = code
                codes.append(code)
            out.append(b"".join(codes))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load(path: str, pattern: str) -> tuple[ByteBPE, ChunkCodes]:
    """The encoder of a rank file, with its table of chunk codes; one per worker process."""

    def make():
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        bpe = ByteBPE(ranks, pattern)
        return bpe, ChunkCodes(bpe.encode_many, limit=350_000)

    return table(("byte_bpe", path, pattern), make)


FIELDS = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of every text. Null texts count as empty and give an empty array; repeated rows stay;
    an empty table gives an empty one; other columns are not read."""

    def run(batches):
        _, codes = load(ranks_path, pattern)
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([array("I", x).tolist() for x in codes.encode_all(texts)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, bytes`` of every row of ids; null ids give empty bytes."""

    def run(batches):
        bpe, _ = load(ranks_path, pattern)
        for doc_ids, ids in rows(batches, "doc_id", "ids"):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([bpe.decode(x or ()) for x in ids], pa.binary())], ["doc_id", "bytes"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's ids and of the bytes they decode to, in one pass that keeps neither.

    Null texts count as empty (no ids, digests of nothing); ties do not arise; repeated rows stay; an empty table gives
    an empty one; columns other than the two named are ignored, whatever their names."""

    def run(batches):
        bpe, codes = load(ranks_path, pattern)
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            n, digest, back = [], [], []
            for packed in codes.encode_all(texts):
                ids = array("I", packed)
                n.append(len(ids))
                digest.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield arrow(FIELDS, (doc_ids, n, digest, back))

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
