"""Vantage-point partitions of 64-bit fingerprints under Hamming distance.

Distances add up over bit blocks, so of two fingerprints within ``radius`` of each
other at least one of ``radius + 1`` blocks lies at distance 0: that block's value is the first-level vantage point,
a ball of radius 0 in the block's own distance, and no pair is missed. Vantage points over all 64 bits alone do not prune
at radius 4: distances between unrelated fingerprints have a standard deviation of 4, so more than half of every split overlaps.
Inside a shard a vantage-point tree splits by distance to a vantage point, compares the bands that the triangle
inequality leaves across the boundary, and skips parts that are already connected. Shards larger than ``shard_rows`` are first cut
by rings of distance to one of their fingerprints; a ring also gets its neighbour, where the partners across its boundary lie.
A shard gives a spanning forest, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 64
#: Rows up to which a vantage-point node is compared directly.
LEAF = 192


class Forest:
    """Links within ``radius`` among fingerprints, as components; ``label`` is an index of each one's component."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        self.parent = list(range(len(fps)))
        every = np.arange(len(fps))
        self.within(every)
        self.label = self.roots(every)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.fromiter((self.find(int(i)) for i in at), np.int64, len(at))

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def direct(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every pair of a and b, as a block of bits; each of a takes its least partner until nothing changes."""
        near = np.bitwise_count(self.fps[a][:, None] ^ self.fps[b][None, :]) <= self.radius
        keep_a, keep_b = near.any(axis=1), near.any(axis=0)
        a, b, near = a[keep_a], b[keep_b], near[np.ix_(keep_a, keep_b)]
        if not len(a):
            return
        la, lb, none = a.copy(), b.copy(), len(self.fps)
        while True:
            na = np.minimum(la, np.where(near, lb[None, :], none).min(axis=1))
            nb = np.minimum(lb, np.where(near, na[:, None], none).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        moved_a, moved_b = la != a, lb != b
        self.unite(a[moved_a], la[moved_a])
        self.unite(b[moved_b], lb[moved_b])

    def blocks(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), LEAF):
            for j in range(0, len(b), LEAF):
                self.direct(a[i : i + LEAF], b[j : j + LEAF])

    def joined(self, *parts: np.ndarray) -> bool:
        first = self.find(int(parts[0][0]))
        return all(self.find(int(i)) == first for part in parts for i in part)

    def split(self, at: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
        """The vantage point among a few of ``at`` and the distance that split it most evenly, and the distances; None if all
        lie about equally far from each of them."""
        best, least = None, len(at) // 50
        for i in (0, len(at) // 2, len(at) - 1):
            d = np.bitwise_count(self.fps[at] ^ self.fps[at[i]]).astype(np.int64)
            inner = np.bincount(d, minlength=BITS + 1).cumsum()
            smaller = np.minimum(inner, len(at) - inner)
            cut = int(smaller.argmax())
            if smaller[cut] > least:
                best, least = (self.fps[at[i]], cut, d), smaller[cut]
        return best

    def within(self, at: np.ndarray) -> None:
        if len(at) < 2:
            return
        if len(at) <= LEAF:
            return self.direct(at, at)
        if self.joined(at):
            return
        found = self.split(at)
        if found is None:
            return self.blocks(at, at)
        _, cut, d = found
        own = at[d <= self.radius]  # the vantage point's own links
        self.unite(own, np.full(len(own), at[int(d.argmin())]))
        inner, outer = d <= cut, d > cut
        self.within(at[inner])
        self.within(at[outer])
        self.across(at[inner & (d > cut - self.radius)], at[outer & (d <= cut + self.radius)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= LEAF * LEAF:
            return self.direct(a, b)
        if self.joined(a, b):
            return
        if len(a) < len(b):
            a, b = b, a
        found = self.split(a)
        if found is None:
            return self.blocks(a, b)
        point, cut, da = found
        db = np.bitwise_count(self.fps[b] ^ point).astype(np.int64)
        self.across(a[da <= cut], b[db <= cut + self.radius])
        self.across(a[da > cut], b[db > cut - self.radius])


def links(distinct: DataFrame, radius: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """``u, v``: a spanning forest, shard by shard, of all links within ``radius`` among the fingerprints in ``distinct.fp``."""
    n = radius + 1
    edges = [BITS * i // n for i in range(n + 1)]
    keys = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", BITS - b), BITS - b + a).alias("key")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    sharded = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.block", "k.key")
    sizes = sharded.groupBy("block", "key").agg(F.count("*").alias("n"), F.min("fp").alias("vantage"))
    large = sizes.where(F.col("n") > shard_rows).select("block", "key", "vantage")
    width = radius + 1
    ring = F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))) / width).cast("int")
    dealt = (
        sharded.join(large, ["block", "key"], "left")
        .withColumn("ring", ring)
        .withColumn("ring", F.explode(F.when(F.col("ring").isNull(), F.array(F.lit(0))).otherwise(F.array("ring", F.col("ring") + 1))))
    )

    def run(batches):
        held, at = [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            if at is not None and batch.num_rows and all(k[0] == x == k[-1] for k, x in zip(keys, at, strict=True)):  # one shard over many batches
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            block, key, ring, fp = (table.column(x).to_numpy() for x in ("block", "key", "ring", "fp"))
            turn = np.flatnonzero((block[1:] != block[:-1]) | (key[1:] != key[:-1]) | (ring[1:] != ring[:-1])) + 1
            if len(turn):
                yield _forest(fp, np.r_[0, turn], radius)
                table = table.slice(int(turn[-1]))
            held, at = table.combine_chunks().to_batches(), (block[-1], key[-1], ring[-1]) if table.num_rows else at
        if held:
            fp = pa.Table.from_batches(held).column("fp").to_numpy()
            yield _forest(fp, np.array([0, len(fp)]), radius)

    return (
        dealt.select("block", "key", "ring", "fp")
        .repartition("block", "key", "ring")
        .sortWithinPartitions("block", "key", "ring")
        .mapInArrow(run, "u long, v long")
    )


def _forest(fp: np.ndarray, bounds: np.ndarray, radius: int) -> pa.RecordBatch:
    """Star links of the shards between the bounds."""
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            own = np.unique(fp[a:b])
            label = Forest(own.view(np.uint64), radius).label
            moved = label != np.arange(len(own))
            us.append(own[moved])
            vs.append(own[label[moved]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
