"""Chroma audio fingerprints, and recordings aligned by them.

A recording's spectra are folded to twelve pitch classes a frame; rectangle filters over the integral image of these
frames give two bits each, sixteen of them one packed integer a frame. Two recordings are aligned at the offset that most equal integers vote
for, and compared by the share of differing bits where they overlap there. Recordings that are looked up are a stated set: they are lent to the
tasks in blocks of bounded size, and each task holds its share of the table against a block, so no value is a key of a shuffle.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import slices, written

RATE, FRAME, HOP = 11025, 4096, 1365
LOW_HZ, HIGH_HZ = 28.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Filters by rule: four splits of a rectangle, each in four sizes and places (split, first pitch class, pitch classes, frames).
FILTERS = tuple((k % 4, (3 * k) % 6, 3 + k % 4 + 2 * (k // 8), 4 + 4 * (k // 4)) for k in range(16))
LONGEST = max(f[3] for f in FILTERS)
#: Log-ratios between a filter's two sides at which its two bits change.
STEP = 0.05
GRAY = np.array([0, 1, 3, 2])
#: Equal integers that an offset needs, integers that must overlap, and the share of differing bits up to which recordings match.
VOTES, OVERLAP, ERRORS = 1, 8, 0.25
#: Bytes of packed integers in a block of queries, and hits of a task that are looked at together.
BLOCK_BYTES, HITS = 32 << 20, 1 << 20


def _folding() -> np.ndarray:
    """Spectrum bin x pitch class."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hz), 12))
    for i in np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ)):
        fold[i, round(12 * np.log2(hz[i] / 440.0)) % 12] = 1.0
    return fold


FOLD, HANN = _folding(), np.hanning(FRAME)
#: The bins that any pitch class has.
FIRST, LAST = np.flatnonzero(FOLD.any(axis=1))[[0, -1]]
FOLD = np.ascontiguousarray(FOLD[FIRST : LAST + 1])


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12, smoothed over five frames and of unit length; silence gives zeros."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12))
    out = np.empty((n, 12))
    for at in range(0, n, 512):  # long recordings in blocks
        count = min(512, n - at)
        frames = np.lib.stride_tricks.as_strided(samples[at * HOP :], (count, FRAME), (HOP * samples.strides[0], samples.strides[0]))
        bins = np.fft.rfft(frames * HANN, axis=1)[:, FIRST : LAST + 1]
        out[at : at + count] = (bins.real**2 + bins.imag**2) @ FOLD
    smooth = sum(w * out[i : n - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    size = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(size > 1e-2, smooth / np.maximum(size, 1e-12), 0.0)


def packed(frames: np.ndarray) -> np.ndarray:
    """A 32-bit integer for every window of LONGEST frames."""
    n = len(frames) - LONGEST + 1
    if n < 1:
        return np.empty(0, np.int32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    image = np.ascontiguousarray(image.T)

    def area(t0, t1, y0, y1):
        return image[y1, t1 : t1 + n] - image[y1, t0 : t0 + n] - image[y0, t1 : t1 + n] + image[y0, t0 : t0 + n]

    out = np.zeros(n, np.uint32)
    for split, y, height, width in FILTERS:
        top = min(12, y + height)
        whole = area(0, width, y, top)
        if split == 0:  # lower against upper pitch classes
            one = area(0, width, y, (y + top) // 2)
        elif split == 1:  # earlier against later frames
            one = area(0, width // 2, y, top)
        elif split == 2:  # opposite quarters
            one = area(0, width // 2, y, (y + top) // 2) + area(width // 2, width, (y + top) // 2, top)
        else:  # the middle frames against those around them
            one = area(width // 4, width - width // 4, y, top)
        ratio = np.log((1 + one) / (1 + whole - one))
        level = (ratio > -STEP).astype(int) + (ratio > 0) + (ratio > STEP)
        out = (out << np.uint32(2)) | GRAY[level].astype(np.uint32)
    return out.view(np.int32)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers of mono samples at RATE; fewer than a window's frames give none."""
    return packed(chroma(np.ascontiguousarray(samples, dtype=np.float64)))


def decode_wav(data: bytes | None) -> np.ndarray:
    """Mono samples at RATE of a 16-bit WAV file; null, empty and unreadable ones give none."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            if f.getsampwidth() != 2 or not f.getnframes():
                return np.empty(0)
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()).mean(axis=1) / 32768
            return np.interp(np.arange(0, len(x), f.getframerate() / RATE), np.arange(len(x)), x)
    except (wave.Error, EOFError):
        return np.empty(0)


#: A vector as a recording: sixteen chords of four notes, each note one of 24 semitones by its value.
CHORD, NOTES = 4096, 4
TONES = np.sin(2 * np.pi * (220.0 * 2 ** (np.arange(24) / 12))[:, None] * np.arange(CHORD) / RATE)


def decode_vector(values) -> np.ndarray:
    """Samples that sound a vector, four values a chord; null gives none, null values count as 0."""
    v = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in values or ()])
    v = np.concatenate([v, np.zeros(-len(v) % NOTES)])
    note = np.floor((v + 0.5) * 24).astype(np.int64) % 24
    loud = np.zeros((len(v) // NOTES, len(TONES)))
    np.add.at(loud, (np.arange(len(v)) // NOTES, note), 0.5 + np.abs(np.clip(v, -1, 1)))
    return (loud @ TONES).ravel()


def fingerprints(recordings: DataFrame, decode=decode_wav, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """``id, fp``: the packed integers of every recording. Media are decoded where they are read and never shuffled; null ones have none."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                prints = [fingerprint(decode(m)) for m in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.list_(pa.int32()))], ["id", "fp"])

    return recordings.select(recordings[id_col].cast("long").alias("id"), recordings[media_col].alias("media")).mapInArrow(run, "id long, fp array<int>")


def classes(prints: DataFrame) -> DataFrame:
    """``class_id, copies, fp``: one row for each different fingerprint."""
    return prints.groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))


def _runs(flat: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Value, owner, first place and length of the runs of equal integers: a held note or silence is one of them, however long."""
    if not len(flat):
        return flat, owner, place, place
    starts = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])])
    return flat[starts], owner[starts], place[starts], np.diff(np.r_[starts, len(flat)])


def _ragged(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of the lengths n, put end to end: which list each element is of, and its place there."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(n.cumsum() - n, n)


class Recordings:
    """Packed integers of several recordings, end to end."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray):
        self.ids, self.flat, self.sizes = ids, flat, sizes
        self.starts = sizes.cumsum() - sizes
        self.value, self.owner, self.at, self.length = _runs(flat, *_ragged(sizes))

    @classmethod
    def of(cls, ids: pa.Array, prints: pa.Array) -> Recordings:
        sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(prints), 0), np.int64)
        return cls(ids.to_numpy(zero_copy_only=False), prints.flatten().to_numpy(zero_copy_only=False), sizes)


class Block(Recordings):
    """Queries, their runs ordered by value."""

    def __init__(self, *parts):
        super().__init__(*parts)
        order = np.argsort(self.value, kind="stable")
        self.value, self.owner, self.at, self.length = (x[order] for x in (self.value, self.owner, self.at, self.length))

    def best(self, pair: np.ndarray, s: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each pair of recordings the offset with the most votes, then the smallest shift, then the larger offset, and its votes.

        Two runs of lengths la and lb vote for the offsets from s on in the shape of a trapezoid: four impulses of its second difference say
        all of it. Sums of trapezoids are straight between impulses, so only these, the ends of each plateau and offset 0 are looked at."""
        low, high = s + np.minimum(la, lb) - 1, s + np.maximum(la, lb) - 1
        x = np.concatenate([s, s + la, s + lb, s + la + lb, low, high, np.zeros_like(s)])
        impulse = np.repeat([1, -1, -1, 1, 0, 0, 0], len(s))
        pair = np.tile(pair, 7)
        order = np.lexsort((x, pair))
        pair, x, impulse = pair[order], x[order], impulse[order]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (x[1:] != x[:-1])])
        pair, x, slope = pair[first], x[first], np.add.reduceat(impulse, first).cumsum()
        gap = np.r_[0, x[1:] - x[:-1] - 1]
        votes = (np.r_[0, slope[:-1]] * gap + slope).cumsum()  # the slope is 0 where a pair ends, so pairs don't mix
        order = np.lexsort((x, -np.abs(x), votes, pair))
        last = order[np.r_[pair[order][1:] != pair[order][:-1], True]]
        return pair[last], x[last], votes[last]

    def matches(self, table: Recordings, votes: int, overlap: int, errors: float):
        """Record batches ``query, match, offset, votes, bits, bit_errors``."""
        left, right = (np.searchsorted(self.value, table.value, side) for side in ("left", "right"))
        n = right - left
        # All runs of a recording stay together, and about HITS hits.
        ends = np.flatnonzero(np.r_[table.owner[1:] != table.owner[:-1], True]) + 1 if len(table.owner) else np.empty(0, np.int64)
        total, begin, done = n.cumsum(), 0, 0
        for end in ends.tolist():
            if (total[end - 1] - done < HITS and end != ends[-1]) or total[end - 1] == done:
                continue
            which, place = _ragged(n[begin:end])
            t, q = which + begin, left[begin:end][which] + place
            begin, done = end, total[end - 1]
            la, lb = self.length[q], table.length[t]
            pair, offset, got = self.best(table.owner[t] * len(self.ids) + self.owner[q], table.at[t] - self.at[q] - la + 1, la, lb)
            b, a = np.divmod(pair, len(self.ids))
            a0, b0 = np.maximum(-offset, 0), np.maximum(offset, 0)
            size = np.minimum(self.sizes[a] - a0, table.sizes[b] - b0)
            keep = (got >= votes) & (size >= overlap) & (self.ids[a] != table.ids[b])
            a, b, a0, b0, size, offset, got = (v[keep] for v in (a, b, a0, b0, size, offset, got))
            wrong = np.zeros(len(size), np.int64)
            cuts = np.flatnonzero(np.diff(size.cumsum() // HITS, prepend=0)).tolist() if len(size) else []
            for i, j in zip([0, *cuts], [*cuts, len(size)], strict=True):
                which, place = _ragged(size[i:j])
                x, y = self.flat[(self.starts[a] + a0)[i:j][which] + place], table.flat[(table.starts[b] + b0)[i:j][which] + place]
                wrong[i:j] = np.bincount(which, np.bitwise_count((x ^ y).view(np.uint32)), j - i)
            near = wrong <= errors * 32 * size
            columns = (self.ids[a], table.ids[b], offset, got, 32 * size, wrong)
            yield pa.RecordBatch.from_arrays([pa.array(c[near].astype(np.int64)) for c in columns], list(ALIGNED))


ALIGNED = ("query", "match", "offset", "votes", "bits", "bit_errors")
ALIGNED_DDL = ", ".join(f"{c} long" for c in ALIGNED)


def alignments(queries: DataFrame, table: DataFrame, votes: int = VOTES, overlap: int = OVERLAP, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query, match, offset, votes, bits, bit_errors``: pairs of different classes that match at their best offset.

    Both have ``class_id, fp``. Every equal integer votes, each of its places against each of the other's, as in the plain offset histogram. The best
    offset has the most votes, then the smallest shift. Queries are lent in as many blocks of about ``block_bytes`` as they need; each block is held against
    the whole table."""
    sized = queries.select("class_id", "fp")
    size = sized.agg(F.sum(F.lit(4) * F.size("fp"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for i in range(blocks):
        own = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == i)
        got = own.where(F.size("fp") > 0).toArrow().combine_chunks()
        ids, prints = (got.column(c).combine_chunks() if got.num_rows else pa.array([], t) for c, t in (("class_id", pa.int64()), ("fp", pa.list_(pa.int32()))))
        ids, prints = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, prints))
        lent = table.sparkSession.sparkContext.broadcast(Block.of(ids, prints))  # about block_bytes

        def run(batches, lent=lent):
            for batch in batches:
                for part in slices(batch):
                    yield from lent.value.matches(Recordings.of(part.column(0), part.column(1)), votes, overlap, errors)

        hits = table.select("class_id", "fp").mapInArrow(run, ALIGNED_DDL)
        found.append(hits if blocks == 1 else written(hits))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def search(recordings: DataFrame, is_query, decode=decode_wav, id_col: str = "id", media_col: str = "media", **limits) -> DataFrame:
    """A row for each recording that ``is_query`` (a column over ``id``) picks: its class, the copies it has, how many other classes and recordings
    match, and the best of them with offset and bit errors (nulls if none).

    Null and too short recordings have an empty fingerprint and match only their copies; repeated rows stay; an empty table gives an
    empty one; other columns are ignored."""
    prints = written(fingerprints(recordings, decode, id_col, media_col))
    table = written(classes(prints))
    of_class = table.select("fp", "class_id", F.col("copies").alias("in_class"))
    rows = written(prints.where(is_query).join(of_class, "fp").select("id", "class_id", "in_class"))
    queries = table.join(rows.select("class_id").distinct(), "class_id", "left_semi")
    found = alignments(queries, table, **limits).join(table.select(F.col("class_id").alias("match"), "copies"), "match")
    rate = (F.col("bit_errors") / F.col("bits")).alias("rate")
    summary = found.groupBy("query").agg(
        F.count("*").alias("n_classes"), F.sum("copies").alias("n_matches"),
        F.min(F.struct(rate, "match", "offset", "bits", "bit_errors")).alias("best"),
    )
    return rows.join(summary, rows["class_id"] == summary["query"], "left").select(
        "id", "class_id", (F.col("in_class") - 1).alias("n_copies"), F.coalesce("n_classes", F.lit(0)).alias("n_classes"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.col("best.match").alias("best_id"), F.col("best.offset").alias("best_offset"), F.col("best.bits").alias("best_bits"), F.col("best.bit_errors").alias("best_bit_errors"),
    )


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of ``embeddings`` sounded as a recording; every fiftieth is looked up among all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("id") % 50 == 0, decode_vector, "vec_id", "embedding").withColumnRenamed("id", "vec_id")
