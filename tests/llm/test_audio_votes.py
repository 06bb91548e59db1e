import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import audio


def test_alignments_without_equal_neighbours(spark):
    r = np.random.default_rng(5)
    whole = r.integers(0, 1 << 32, 27, dtype=np.uint32)
    part = whole.copy()
    part[::2] ^= np.uint32(1) << r.integers(0, 32, 14).astype(np.uint32)
    rows = [(i, x.view(np.int32).tolist()) for i, x in enumerate([whole, part, r.integers(0, 1 << 32, 27, dtype=np.uint32)])]
    table = spark.createDataFrame(rows, "class_id long, fp array<int>")
    got = audio.alignments(table, table).collect()
    assert sorted((g.query, g.match, g.offset, g.votes, g.bit_errors) for g in got) == [(0, 1, 0, 13, 14), (1, 0, 0, 13, 14)]


def test_recall_under_independent_bit_errors(spark):
    """Held against offsets and bit errors alone: each copy is within the errors at offset 0."""
    r = np.random.default_rng(6)
    whole = r.integers(0, 1 << 32, (100, 27), dtype=np.uint32)
    flips = np.packbits(r.random((100, 27, 32)) < 0.05, axis=2).view(">u4")[:, :, 0].astype(np.uint32)
    assert (np.bitwise_count(flips).sum(axis=1) <= audio.ERRORS * 27 * 32).all()
    frame = lambda x, first: spark.createDataFrame([(first + i, p.view(np.int32).tolist()) for i, p in enumerate(x)], "class_id long, fp array<int>")
    got = audio.alignments(frame(whole ^ flips, 1000), frame(whole, 0)).collect()
    assert sum(g.query == g.match + 1000 and g.offset == 0 for g in got) >= 95
