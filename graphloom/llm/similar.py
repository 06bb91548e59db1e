"""Near copies: all pairs of documents that share a part of their word shingles, as groups.

Two sets that share four fifths of their elements share one of the first fifth of each in any order that holds for all sets (a prefix filter), so
no pair is missed; with rare elements first, few others meet. Pairs inside a group need no second link, so most near copies are linked
beforehand: each document gets a wider SimHash (128 bits), half of which goes through the vantage-point trees of ``vantage``, and meets others that agree on samples of its bits. What the samples miss, the prefixes
find. No link counts before the two sets have been held against each other. Sets of shingles are never stored for all documents: they are made
again from the texts, for the prefixes and for those with a candidate that the prefixes alone don't rule out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import forget, rows, slices, texts_of, written
from graphloom.llm.components import components
from graphloom.llm.vantage import links

BITS = 128
#: Share of links at the mean distance of the wanted similarity that the samples may miss (the prefixes find them), and rows that a bucket holds on average.
MISSED, BUCKET = 0.03, 64
#: Standard deviations of the bit distance within which the samples take a pair as a candidate.
WIDE = 2.6
#: Slots in which shingles are counted, and what rounding may take from a bound.
SLOTS, SLACK = 1 << 20, 1e-6
#: Bytes of ids up to which they are broadcast (a hashed one takes about eight times as much); beyond, the joins shuffle both sides.
BROADCAST_BYTES = 4 << 20
#: Bits of a shingle's hash, and pairs of one document that a task compares: one with more is sent to several.
HASH_BITS, SHARE = 48, 2048
#: Turns in which groups are joined by few pairs each before all pairs between those left are tried.
STARS = 2
#: Bits of the filter of shared shingles; one of a fixed size, so it lets more pass as the input grows, and the join behind it decides.
FILTER_BITS = 1 << 26


def shingles(text: str, words: int) -> set[bytes]:
    """The different word shingles of a text, A-Z lower-cased; a shorter text is one shingle, an empty one has none."""
    parts = text.encode().lower().split()
    if len(parts) <= words:
        return {b" ".join(parts)} if parts else set()
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    stops = lengths.cumsum() + np.arange(len(parts))
    return {joined[a:b] for a, b in zip((stops - lengths).tolist(), stops[words - 1 :].tolist(), strict=False)}


def sketch(raw: bytes) -> bytes:
    """The 128 bits that over half of the shingles' hashes (``raw``, one after another) have."""
    n = len(raw) // 16
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 128):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, min(n - at, 255 * 128) * 16, at * 16)).reshape(-1, BITS)
        for block in range(0, len(bits), 255):
            counts += bits[block : block + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n).tobytes()


def hashes(raw: bytes) -> np.ndarray:
    """A set's elements, sorted: the low bits of its shingles' digests (``raw``, one after another)."""
    return np.unique(np.frombuffer(raw, "<i8")[::2] & ((1 << HASH_BITS) - 1))


def set_of(text: str, words: int) -> np.ndarray:
    """A text's different shingles as sorted hashes."""
    return hashes(b"".join(map(xxhash.xxh3_128_digest, shingles(text, words))))


HASHED = {"row": pa.int64(), "key": pa.int64(), "hi": pa.int64(), "lo": pa.int64(), "part": pa.int32(), "task": pa.int32(), "n": pa.binary()}
HASHED_DDL = "row long, key long, hi long, lo long, part int, task int, n binary"
#: Parts in which a task's slots are sent.
PARTS = 64


def hashed(texts: DataFrame, words: int) -> DataFrame:
    """``row, key, hi, lo`` of every text (``row, text``): a hash of its set of shingles, equal for equal sets, and their sketch; and after them, a
    task's share of how often shingles fall into each of SLOTS slots by their low bits (``part, task, n``, the other columns null)."""

    def run(batches):
        forget()
        digest, key = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        total = np.zeros(SLOTS, np.int64)
        for ids, block in rows(batches, "row", "text"):
            keys, bits, sets = [], [], [np.empty(0, np.int64)]
            for text in block:
                raw = b"".join(map(digest, shingles(text, words)))
                own = hashes(raw)
                sets.append(own & (SLOTS - 1))
                keys.append(key(own.tobytes()))
                bits.append(sketch(raw))
            total += np.bincount(np.concatenate(sets), minlength=SLOTS)
            halves = np.frombuffer(b"".join(bits), ">i8").astype(np.int64).reshape(-1, 2)
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, np.array(keys, np.uint64).view(np.int64), halves[:, 0], halves[:, 1], none, none, none), HASHED.values(), strict=True)], list(HASHED))
        own = [zlib.compress(x.tobytes(), 1) for x in np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).reshape(PARTS, -1)]
        none, task = [None] * PARTS, TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, range(PARTS), [task] * PARTS, own), HASHED.values(), strict=True)], list(HASHED))

    return texts.mapInArrow(run, HASHED_DDL)


def differing(similarity: float) -> float:
    """The share of bits in which two sets of the similarity (Jaccard) differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampling(n: int, similarity: float) -> tuple[int, int]:
    """Bits in a sample so that a bucket holds about BUCKET of n rows, and samples so that MISSED of the links are missed."""
    bits = max(12, min(40, math.ceil(math.log2(max(n, 2) / BUCKET))))
    return bits, math.ceil(math.log(MISSED) / math.log(1 - (1 - differing(similarity)) ** bits))


def limit(similarity: float) -> int:
    """The bit distance up to which a pair that agrees on a sample is a candidate."""
    p = differing(similarity)
    return int(BITS * p + WIDE * math.sqrt(BITS * p * (1 - p)))


def bucket_links(doc_id: np.ndarray, hi: np.ndarray, lo: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of a bucket's rows to leaders, the rows in the order given; a row that is linked leads no more."""
    out, pool = [], np.arange(len(doc_id))
    if len(pool) <= 1024:
        d = np.bitwise_count(hi[:, None] ^ hi[None, :]).astype(np.int16) + np.bitwise_count(lo[:, None] ^ lo[None, :])
        near = d <= most
        pool = np.flatnonzero(near.sum(axis=1) > 1)
    while len(pool) > 1:
        first, rest = pool[0], pool[1:]
        own = d[first, rest] if len(doc_id) <= 1024 else np.bitwise_count(hi[rest] ^ hi[first]).astype(np.int16) + np.bitwise_count(lo[rest] ^ lo[first])
        hit = own <= most
        if hit.any():
            found = doc_id[rest[hit]]
            out.append((np.full(len(found), doc_id[first]), found, own[hit]))
        pool = rest[~hit]
    return out


LINK = {"u": pa.int64(), "v": pa.int64(), "d": pa.int32()}


def _links(table: pa.Table, bounds: np.ndarray, most: int) -> pa.RecordBatch:
    doc_id, hi, lo = (table.column(c).to_numpy() for c in ("doc_id", "hi", "lo"))
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int16))]
    wide = np.flatnonzero(np.diff(bounds) > 1)
    for a, b in zip(bounds[wide].tolist(), bounds[wide + 1].tolist(), strict=True):
        parts += bucket_links(doc_id[a:b], hi[a:b], lo[a:b], most)
    u, v, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64()), pa.array(d, pa.int32())], list(LINK))


def candidate_links(sketches: DataFrame, n: int, similarity: float) -> DataFrame:
    """``u, v, d``: links within the candidate distance that the samples find (``sketches``: ``doc_id, hi, lo``, different sketches)."""
    bits, samples = sampling(n, similarity)
    most = limit(similarity)
    places = np.random.default_rng(17)
    chosen = [np.sort(places.choice(BITS, bits, replace=False)) for _ in range(samples)]
    weights = 1 << np.arange(bits, dtype=np.int64)

    def deal(batches):
        for batch in batches:
            doc_id, hi, lo = (batch.column(i) for i in range(3))
            raw = np.stack([hi.to_numpy().astype(">i8"), lo.to_numpy().astype(">i8")], axis=1)
            flags = np.unpackbits(raw.view(np.uint8).reshape(-1, 16), axis=1).astype(np.int64)
            for t, at in enumerate(chosen):
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(t) << 44) | (flags[:, at] @ weights)), doc_id, hi, lo], ["bucket", "doc_id", "hi", "lo"])

    def solve(batches):
        held, at = [], None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            if at is not None and len(bucket) and bucket[0] == at == bucket[-1]:  # one bucket over many batches: put together once
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            bucket = table.column("bucket").to_numpy()
            turn = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            if len(turn):
                yield _links(table, np.r_[0, turn], most)
                table = table.slice(int(turn[-1]))
            held, at = table.combine_chunks().to_batches(), bucket[-1] if len(bucket) else at
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield _links(table, np.array([0, table.num_rows]), most)

    dealt = sketches.select("doc_id", "hi", "lo").mapInArrow(deal, "bucket long, doc_id long, hi long, lo long")
    sorted_rows = dealt.repartition("bucket").sortWithinPartitions("bucket", F.xxhash64("bucket", "doc_id"))  # another order, so other leaders, in each sample
    return sorted_rows.mapInArrow(solve, "u long, v long, d int").groupBy("u", "v").agg(F.min("d").alias("d"))


def small(df: DataFrame, longs: int = 1) -> DataFrame:
    """``df`` (stored, ``longs`` long columns), marked for broadcasting if that is cheap."""
    return F.broadcast(df) if 8 * longs * df.count() <= BROADCAST_BYTES else df


def summed(parts: DataFrame, kind, combine) -> DataFrame:
    """``part, n``: the compressed arrays of all tasks combined by part. They come in twice, so that no task reads those of all others, and
    one by one, so that it holds two of them."""

    def run(batches):
        at, total = None, None
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(n), kind)
                if part != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "n"])
                    at, total = part, own.copy()
                else:
                    total = combine(total, own)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "n"])

    some = parts.select("part", "n", F.pmod("task", F.lit(16)).alias("turn")).repartition("part", "turn").sortWithinPartitions("part", "turn").select("part", "n")
    return some.mapInArrow(run, "part int, n binary").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, n binary")


def frequencies(parts: DataFrame) -> np.ndarray:
    """How many of all sets' elements fall into each slot, from the tasks' shares: SLOTS numbers, however many documents there are."""
    out = np.zeros((PARTS, SLOTS // PARTS), np.uint32)
    for part, n in summed(parts, np.uint32, lambda a, b: np.where(a > np.iinfo(np.uint32).max - b, np.iinfo(np.uint32).max, a + b)).collect():
        out[part] = np.frombuffer(zlib.decompress(n), np.uint32)
    return out.ravel()


FIRSTS = {"row": pa.int64(), "size": pa.int32(), "p": pa.list_(pa.int64())}


def prefixes(texts: DataFrame, often: np.ndarray, words: int, similarity: float) -> DataFrame:
    """``row, size, p``: of each text's set those first elements, rare ones first, of which two sets of the similarity must share one. Any order does,
    if it is the same for all sets; this one keeps common shingles at the end."""
    lent = texts.sparkSession.sparkContext.broadcast(often)  # SLOTS numbers

    def run(batches):
        often = lent.value
        for ids, block in rows(batches, "row", "text"):
            sizes, heads = [], []
            for text in block:
                own = set_of(text, words)
                first = len(own) - math.ceil(similarity * len(own) - SLACK) + 1
                sizes.append(len(own))
                heads.append(own[np.lexsort((own, often[own & (SLOTS - 1)]))[:first]])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, sizes, heads), FIRSTS.values(), strict=True)], list(FIRSTS))

    return texts.mapInArrow(run, "row long, size int, p array<long>")


def near_fingerprints(keys: DataFrame, radius: int = 4) -> DataFrame:
    """``u, v``: candidates among ``keys`` (``node, hi``) whose 64-bit SimHashes, the upper halves of their sketches, are equal or that vantage-point trees
    link within ``radius`` bits. At most two a node."""
    firsts = written(keys.groupBy("hi").agg(F.min("node").alias("rep")))
    equal = keys.join(firsts, "hi").where("node != rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    end = lambda fp, rep: firsts.select(F.col("hi").alias(fp), F.col("rep").alias(rep))
    far = links(firsts.select(F.col("hi").alias("fp")), radius).withColumnsRenamed({"u": "fu", "v": "fv"})
    return equal.unionByName(far.join(end("fu", "u"), "fu").join(end("fv", "v"), "fv").select("u", "v"))


def shared_elements(firsts: DataFrame) -> DataFrame:
    """``s``: the elements that prefixes (``root, p``) of different roots have."""
    roots = firsts.select("root", F.explode("p").alias("s")).groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    return written(roots.where("a < b").select("s"))


def _bit(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) >> np.uint64(20)) & np.uint64(FILTER_BITS - 1)


def met_elements(firsts: DataFrame, shared: DataFrame) -> DataFrame:
    """``s, row, root, size, at``: where prefixes (``row, root, size, p``) have a shared element, ``at`` its place there.

    A bit filter of a fixed size drops most others before the join that decides."""

    def mark(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _bit(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        task = TaskContext.get().partitionId()
        own = [zlib.compress(x.tobytes(), 1) for x in bits.reshape(PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array(own, pa.binary())], ["part", "task", "n"])

    parts = summed(shared.mapInArrow(mark, "part int, task int, n binary"), np.uint8, np.bitwise_or).collect()
    bits = np.zeros((PARTS, FILTER_BITS // 8 // PARTS), np.uint8)
    for part, n in parts:
        bits[part] = np.frombuffer(zlib.decompress(n), np.uint8)
    lent = shared.sparkSession.sparkContext.broadcast(bits.ravel())  # FILTER_BITS bits

    def run(batches):
        bits = lent.value
        for batch in batches:
            for part in slices(batch):
                p = part.column(3)
                flat, n = p.flatten().to_numpy(), pyarrow.compute.list_value_length(p).to_numpy()
                owner = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(flat)) - np.repeat(n.cumsum() - n, n)
                at = _bit(flat)
                keep = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                who = owner[keep]
                columns = [flat[keep], *(part.column(i).to_numpy()[who] for i in range(3)), place[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["s", "row", "root", "size", "at"])

    kept = firsts.select("row", "root", "size", "p").mapInArrow(run, "s long, row long, root long, size int, at int")
    return written(kept.join(small(shared), "s", "left_semi"))


def star_pairs(met: DataFrame, turn: int = 0) -> DataFrame:
    """``u, v``: for each shared element a row of every root that has it, against one of the smallest root: linear in the elements met.

    Which rows stand for their roots differs from element to element, so a row meets many of a large group, and from turn to turn."""
    each = met.groupBy("s", "root").agg(F.min_by("row", F.xxhash64(F.lit(turn), "s", "row")).alias("row"))
    hubs = each.groupBy("s").agg(F.min(F.struct("root", "row")).alias("hub"))
    return each.join(hubs, "s").where("hub.root < root").select(F.col("row").alias("u"), F.col("hub.row").alias("v")).distinct()


def pairs_between(met: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: every pair of rows of different roots that may have the similarity; none that has it is left out.

    Two such sets share an element of their prefixes, and at the first that they share enough elements are left in both."""
    a, b = met.alias("a"), met.alias("b")
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    enough = left >= similarity / (1 + similarity) * (F.col("a.size") + F.col("b.size")) - SLACK
    return a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.root") < F.col("b.root")) & enough).select(F.col("b.row").alias("u"), F.col("a.row").alias("v")).distinct()


def possible(pairs: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` that may have the similarity by their prefixes (``row, size, p``) alone; none that has it is left out.

    Of two prefixes one ends first in the common order; what that set shares with the other lies in both prefixes or behind its own. So a pair that has
    little more in common than a passage is seen without its whole sets."""
    side = lambda row, p, n: firsts.select(F.col("row").alias(row), F.col("p").alias(p), F.col("size").alias(n))
    both = pairs.join(side("u", "pu", "nu"), "u").join(side("v", "pv", "nv"), "v")
    most = F.size(F.array_intersect("pu", "pv")) + F.greatest(F.col("nu") - F.size("pu"), F.col("nv") - F.size("pv"))
    enough = F.least(most, F.col("nu"), F.col("nv")) >= similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - SLACK
    return both.where(enough).select("u", "v")


def _packed(s: np.ndarray) -> bytes:
    """Sorted hashes at HASH_BITS each."""
    return s.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // HASH_BITS, 8), np.uint8)
    out[:, : HASH_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BITS // 8)
    return out.view("<i8").ravel()


def verified(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``u, v``: rows of ``texts``) that share the wanted part of their shingles (stored).

    The set of u is sent to v, once a pair; a v with many partners goes to as many tasks as they need."""
    pairs = written(pairs)
    if not pairs.head(1):
        return pairs
    hubs = written(pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")))
    dealt = written(pairs.join(small(hubs, 2), "v").select(F.col("u").alias("row"), "v", F.pmod(F.xxhash64("u"), "shares").cast("int").alias("share")))

    def sets(batches):
        for batch in batches:
            for part in slices(batch):
                own = [_packed(set_of(t, words)) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(own, pa.binary())], ["v", "share", "u", "s"])

    kind = "v long, share int, u long, s binary"
    sent = texts.join(small(dealt, 3), "row").select("v", "share", F.col("row").alias("u"), "text").mapInArrow(sets, kind)
    own = texts.join(small(hubs.withColumnRenamed("v", "row"), 2), "row").select(F.col("row").alias("v"), F.col("shares").alias("share"), F.lit(None).cast("long").alias("u"), "text").mapInArrow(sets, kind)
    own = own.select("v", F.explode(F.sequence(F.lit(0), F.col("share") - 1)).alias("share"), "u", "s")

    def compare(batches):
        held = None
        for batch in batches:
            for part in slices(batch):
                us, vs = [], []
                for v, u, s in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    own = _unpacked(s)
                    if u is None:
                        held = own
                        continue
                    common = len(np.intersect1d(own, held, assume_unique=True))
                    if common >= similarity * (len(own) + len(held) - common):
                        us.append(u)
                        vs.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    met = own.unionByName(sent).repartition("v", "share").sortWithinPartitions("v", "share", F.col("u").asc_nulls_first())
    return written(met.mapInArrow(compare, "u long, v long"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` (stored) after ``links`` (``u, v``: nodes, stored) have joined roots."""
    if not links.head(1):
        return roots
    between = links.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
    top = components(between.where("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return written(roots.join(small(written(top), 2), "root", "left").select("node", F.coalesce("_top", "root").alias("root")))


def row_groups(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``row, root`` (stored) of every row of ``texts`` (stored: ``row`` unique, ``text``): rows with the same shingles link, and all pairs that share
    ``similarity`` of them or more; no others, and none is missed. Root is one row of the group."""
    first = written(hashed(texts, words))
    rows_of = first.where("part is null").select("row", "key", "hi", "lo")
    often = frequencies(first.where("part is not null"))
    keys = written(rows_of.groupBy("key").agg(F.min("row").alias("node"), F.min("hi").alias("hi"), F.min("lo").alias("lo")))
    firsts = written(prefixes(texts, often, words, similarity).join(small(keys.select(F.col("node").alias("row"))), "row"))
    near = candidate_links(keys.select(F.col("node").alias("doc_id"), "hi", "lo"), keys.count(), similarity)
    nearest = near.groupBy("u").agg(F.min_by("v", "d").alias("v")).unionByName(near_fingerprints(keys)).distinct()
    sure = verified(texts, possible(nearest, firsts, similarity), words, similarity)
    roots = merged(written(keys.select("node", F.col("node").alias("root"))), sure)
    rooted = lambda df: df.join(small(roots.withColumnRenamed("node", "row"), 2), "row")
    own = written(rooted(firsts).select("row", "root", "size", "p"))
    met = met_elements(own, shared_elements(own))
    for turn in range(STARS):
        found = verified(texts, possible(star_pairs(met, turn), firsts, similarity), words, similarity)
        if not found.head(1):
            break
        roots = merged(roots, found)
        met = written(rooted(met.drop("root")))
    roots = merged(roots, verified(texts, possible(pairs_between(met, similarity), firsts, similarity), words, similarity))
    # Written, so that the join deals both sides anew and Spark can split the partition of a much copied text.
    classes = written(keys.select("key", "node").join(roots, "node").select("key", "root"))
    return written(rows_of.select("row", "key").join(classes, "key").select("row", "root"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id`` of the documents that a link joins to a smaller doc_id, group_id the smallest that links reach.

    Documents with the same shingles link, and all pairs that share ``similarity`` of them or more; no others, and none is missed. Null and empty
    texts are alike; rows without a doc_id take no part; rows with one doc_id are told apart by their place, so one that has several texts may stand
    in several groups; an empty table gives an empty one; other columns are ignored."""
    texts = written(texts_of(docs, id_col, text_col).where("doc_id is not null").withColumn("row", F.monotonically_increasing_id()))
    found = texts.select("row", "doc_id").join(row_groups(texts.select("row", "text"), words, similarity), "row")
    group = written(found.groupBy("root").agg(F.min("doc_id").alias("group_id")))
    return found.join(group, "root").where("doc_id != group_id").select("doc_id", "group_id").distinct()
