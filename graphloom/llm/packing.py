"""Best-fit packing by exact-complement hashing over the histogram of piece lengths.

Lengths are bounded by the sequence length, so the plan is made on the driver from at most ``capacity`` counts,
however many documents there are: sums of one, two and three lengths that fill a sequence exactly are consumed as often as counts allow,
the rest goes best-fit, longest first. The plan is a list of runs of like sequences; pieces find their place by their rank
among the pieces of their length: their number within the task that wrote them, after the pieces of all tasks before it. So no length, however
common, meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import arrow, rows, texts_of, written
from graphloom.llm.library_tokens import document_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_FIELDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Runs ``(sequences, ((length, times), ...))`` that use every counted piece once and overfill nothing.

    On odd histograms early exact triples can strand long pieces, so sums of up to three, two and one lengths are tried and
    the plan with the fewest sequences stays."""
    return min((plan_by_sums(counts, capacity, most) for most in (3, 2, 1)), key=lambda runs: sum(n for n, _ in runs))


def plan_by_sums(counts: dict[int, int], capacity: int, most: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """One plan: exact sums of at most ``most`` lengths, then best fit."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left[length] += n
    runs: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def consume(*lengths: int) -> None:
        times = {x: lengths.count(x) for x in lengths}
        n = min(int(left[x]) // k for x, k in times.items())
        if n > 0:
            for x, k in times.items():
                left[x] -= n * k
            runs.append((n, tuple(times.items())))

    consume(capacity)
    for a in range(capacity - 1, (capacity - 1) // 2, -1) if most > 1 else ():  # the complement of a is looked up, not searched
        if left[a] and left[capacity - a]:
            consume(a, capacity - a)
    for a in range(capacity - 2, (capacity + 2) // 3 - 1, -1) if most > 2 else ():
        if not left[a]:
            continue
        rest = capacity - a
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        for x in b[(left[b] > 0) & (left[rest - b] > 0)][::-1]:
            if left[a] and left[x] and left[rest - x]:
                consume(a, int(x), int(rest - x))
    # Best fit for the residue, longest first: open sequences grouped by room, groups split as they are filled.
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, parts: tuple) -> None:
        if n:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append([n, parts])

    for length in range(capacity, 0, -1):
        due = int(left[length])
        while due:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                full, over = divmod(due, per)
                put(capacity - per * length, full, ((length, per),))
                put(capacity - over * length, 1 if over else 0, ((length, over),))
                due = 0
                continue
            room = rooms[at]
            n, parts = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            per = room // length
            full = min(n, due // per)
            put(room - per * length, full, (*parts, (length, per)))
            due -= full * per
            n -= full
            if n and due:  # fewer than a sequence's share are left
                put(room - due * length, 1, (*parts, (length, due)))
                due, n = 0, n - 1
            put(room, n, parts)
    runs += [(n, parts) for groups in open_by_room.values() for n, parts in groups]
    return runs


class Places:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, runs):
        taken: dict[int, int] = {}
        slots, first = [], 0
        for n, parts in runs:
            offset = 0
            for length, times in parts:
                slots.append((length, taken.get(length, 0), times, first, offset))
                taken[length] = taken.get(length, 0) + n * times
                offset += length * times
            first += n
        self.sequences = first
        table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
        self.key = table[:, 0] << 44 | table[:, 1]
        _, self.start, self.times, self.first, self.offset = table.T

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        turn, within = np.divmod(rank - self.start[at], self.times[at])
        return self.first[at] + turn, self.offset[at] + within * length


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids followed by ``end_id``. Only documents longer than ``capacity`` are cut, into full pieces
    after a first one that takes the remainder.

    Texts are read whole, however long: one is encoded at a time, and its ids are held at four bytes each. Null texts count as empty, null and
    repeated ids stay, an empty table gives an empty one."""
    return texts_of(docs, id_col, text_col).mapInArrow(_cutter(tokenizer_path, capacity, end_id), PIECES)


def _cutter(tokenizer_path: str, capacity: int, end_id: int):
    """A function from batches of ``doc_id, text`` to batches of pieces."""

    def run(batches):
        encode, end = document_ids(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            out: list[tuple] = []
            for doc_id, packed in zip(doc_ids, encode(texts), strict=True):
                ids = packed + end
                n = len(ids) // 4
                at, piece, stop = 0, 0, n % capacity or min(n, capacity)
                while at < n:
                    out.append((doc_id, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at, piece, stop = stop, piece + 1, stop + capacity
            yield arrow(PIECE_FIELDS, zip(*out, strict=True))

    return run


def _numbered(batches, capacity: int):
    """Batches of pieces with the task that they are in (``_part``) and their number among those of their length there (``_rank``)."""
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for b in batches:
        length = b.column(b.schema.get_field_index("length")).to_numpy()
        order = np.argsort(length, kind="stable")
        ends = length[order]
        first = np.searchsorted(ends, ends)  # where a length begins in the order
        rank = np.empty(len(length), np.int64)
        rank[order] = seen[ends] + np.arange(len(length)) - first
        seen += np.bincount(length, minlength=capacity + 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(rank)], [*b.schema.names, "_part", "_rank"])


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (any columns, among them ``length``) with ``sequence_id`` and a gapless ``offset``.

    The pieces are written once, numbered by length within their task. The plan needs one total per length (at most ``capacity`` rows reach the
    driver); what tasks before have of a length comes by a join on task and length, of which no pair has more rows than a task. No text or id moves."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return _placed(written(pieces.mapInArrow(lambda batches: _numbered(batches, capacity), f"{kinds}, _part long, _rank long")), kinds, capacity)


def _placed(numbered: DataFrame, kinds: str, capacity: int) -> DataFrame:
    """The stored rows of ``_numbered`` with their places; kinds: the types of the pieces' own columns."""
    names = [c for c in numbered.columns if c not in ("_part", "_rank")]
    shares = written(numbered.groupBy("length", "_part").agg(F.count("*").alias("_n")))
    places = Places(plan(dict(map(tuple, shares.groupBy("length").agg(F.sum("_n")).collect())), capacity))
    lent = numbered.sparkSession.sparkContext.broadcast(places)  # bounded by capacity, not by the rows
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = numbered.join(shares.select("length", "_part", before.alias("_before")), ["length", "_part"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_rank")).alias("_rank"))

    def run(batches):
        places = lent.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "_rank"))
            sequence, offset = places.of(length, rank)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places, in as few sequences as the method finds.

    Null texts count as empty and pack as the single ``end_id``; rows with one doc_id several times are packed each (which
    of them gets which place is then open); an empty table gives an empty one; other columns are ignored.

    Pieces are cut and numbered in one pass of Python: two in a row would take two worker processes a task, and Spark keeps all of them."""
    cut = _cutter(tokenizer_path, capacity, end_id)
    numbered = texts_of(docs, id_col, text_col).mapInArrow(lambda batches: _numbered(cut(batches), capacity), f"{PIECES}, _part long, _rank long")
    return _placed(written(numbered), PIECES, capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
