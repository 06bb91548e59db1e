import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing

FIFTY = P.path("byte_bpe_50k.json")


def check_plan(counts, capacity):
    runs = packing.plan(counts, capacity)
    used = Counter()
    for n, parts in runs:
        assert n > 0 and sum(x * k for x, k in parts) <= capacity
        for x, k in parts:
            used[x] += n * k
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(n for n, _ in runs)


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_each_piece_once_and_beats_or_ties_plain_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 16, 50, 128])
    counts = {x: r.randrange(1, 60) for x in r.sample(range(1, capacity + 1), r.randrange(1, min(capacity, 30)))}
    n = check_plan(counts, capacity)
    bins = []
    for x in sorted((x for x, k in counts.items() for _ in range(k)), reverse=True):
        fit = min((i for i, room in enumerate(bins) if room >= x), key=lambda i: bins[i], default=None)
        if fit is None:
            bins.append(capacity - x)
        else:
            bins[fit] -= x
    assert -(-sum(x * k for x, k in counts.items()) // capacity) <= n <= len(bins) * 1.03 + 1


def test_places_are_gapless():
    counts = {5: 13, 3: 9, 2: 40, 1: 3, 10: 2}
    places = packing.Places(packing.plan(counts, 10))
    at = defaultdict(list)
    for x, k in counts.items():
        s, o = places.of(np.full(k, x), np.arange(k))
        for a, b in zip(s, o, strict=True):
            at[int(a)].append((int(b), x))
    assert len(at) == places.sequences
    for row in at.values():
        end = 0
        for o, x in sorted(row):
            assert o == end
            end += x
        assert end <= 10


def test_documents(spark, docs_edge):
    got = packing.pack_documents(docs_edge, FIFTY).collect()
    lib, seen, by_sequence = Tokenizer.from_file(FIFTY), defaultdict(list), defaultdict(list)
    for r in got:
        seen[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d in docs_edge.collect():
        ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(seen[d.doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert len(pieces) == 1 if len(ids) <= 2048 else all(p.length == 2048 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(array("I", ids[p.start : p.start + p.length]).tobytes())
    for row in by_sequence.values():
        end = 0
        for offset, length in sorted(row):
            assert offset == end
            end += length
        assert end <= 2048


def test_empty_table(spark, docs_edge):
    assert packing.pack_documents(docs_edge.limit(0), FIFTY).count() == 0


def test_a_much_repeated_row_is_placed_piece_by_piece(spark):
    docs = spark.range(500).selectExpr("7L doc_id", "'the same words again' text").unionByName(spark.createDataFrame([(None, "x y"), (8, "words " * 3000)], "doc_id long, text string")).repartition(5)
    by_sequence = defaultdict(list)
    for r in packing.pack_documents(docs, FIFTY).collect():
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, by_sequence.values())) == 503
    for row in by_sequence.values():
        end = 0
        for offset, length in sorted(row):
            assert offset == end
            end += length
        assert end <= 2048


def test_a_task_takes_one_worker_process(spark, docs_edge, monkeypatch):
    # Two Python steps in one stage take two workers a task, all of which Spark keeps, with their tables, for the rest of the session.
    plans, written = [], packing.written

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(packing, "written", seen)
    out = packing.pack_documents(docs_edge, FIFTY)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert [p.count("MapInArrow") for p in plans] == [1, 0, 1]
    pieces = lambda df: sorted(df.select("doc_id", "piece", "start", "length", "ids_crc32").collect(), key=str)
    assert pieces(out) == pieces(packing.place_pieces(packing.cut_pieces(docs_edge, FIFTY)))
