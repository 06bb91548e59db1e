import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import audio


def tune(seed, chords=40):
    r = np.random.default_rng(seed)
    return audio.decode_vector((r.random(chords * audio.NOTES) - 0.5).tolist())


def wav(samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(audio.RATE)
        f.writeframes((np.clip(samples / 8, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def brute(a, b):
    """Best offset and bit errors over all offsets with enough votes."""
    best = None
    for offset in range(-len(a) + 1, len(b)):
        i, j = max(0, -offset), max(0, offset)
        n = min(len(a) - i, len(b) - j)
        x, y = a[i : i + n], b[j : j + n]
        votes = int((x == y).sum())
        if votes >= audio.VOTES:
            key = (votes, -abs(offset), offset)
            if best is None or key > best[0]:
                best = (key, n, int(np.bitwise_count((x ^ y).view(np.uint32)).sum()))
    if best and best[1] >= audio.OVERLAP and best[2] <= audio.ERRORS * best[1] * 32:
        return best[0][2], best[0][0], best[1] * 32, best[2]
    return None


def test_integral_image_filters_match_plain_sums():
    frames = audio.chroma(tune(1))
    got = audio.packed(frames)
    for at in (0, 7, len(got) - 1):
        code = 0
        for split, y, height, width in audio.FILTERS:
            top = min(12, y + height)
            box = frames[at : at + width, y:top]
            h, w = (y + top) // 2 - y, width // 2
            one = {0: box[:, :h].sum(), 1: box[:w].sum(), 2: box[:w, :h].sum() + box[w:, h:].sum(), 3: box[width // 4 : width - width // 4].sum()}[split]
            ratio = np.log((1 + one) / (1 + box.sum() - one))
            code = code << 2 | [0, 1, 3, 2][int(ratio > -audio.STEP) + int(ratio > 0) + int(ratio > audio.STEP)]
        assert got.view(np.uint32)[at] == code


def test_excerpt_with_noise_aligns(spark):
    whole = tune(2)
    start = 10 * audio.HOP
    part = whole[start : start + 70_000] + np.random.default_rng(0).normal(0, 0.02, 70_000)
    rows = [(1, wav(whole)), (2, wav(part)), (3, wav(tune(3))), (4, wav(whole)), (5, None), (6, b"junk"), (50, wav(part))]
    table = spark.createDataFrame(rows, "id long, media binary")
    got = {r.id: r for r in audio.search(table, F.col("id") % 2 == 0).collect()}
    assert got[2].best_id == 1 and got[2].best_offset == 10 and got[2].n_matches == 2 and got[2].n_copies == 1
    assert got[4].class_id == 1 and got[4].best_id == 2 and got[4].best_offset == -10
    assert got[6].best_id is None and got[6].n_copies == 1  # null and unreadable media share the empty fingerprint


@pytest.mark.parametrize("copies", [0, 40])
def test_search_against_brute_force(spark, copies):
    r = np.random.default_rng(7)
    base = [r.random(64) - 0.5 for _ in range(8)]
    vectors = [x + (r.random(64) < 0.1) * r.normal(0, 0.05, 64) for x in base for _ in range(3)] + [base[0]] * copies
    table = spark.createDataFrame([(i, x.astype(float).tolist(), "x") for i, x in enumerate(vectors)], "id long, media array<float>, fp string")
    got = audio.search(table, F.col("id") % 5 == 0, audio.decode_vector).collect()
    prints = [audio.fingerprint(audio.decode_vector(np.float32(x).tolist())) for x in vectors]
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p.tobytes(), i)
    copies_of = {c: sum(p.tobytes() == k for p in prints) for k, c in first.items()}
    assert sorted(g.id for g in got) == [i for i in range(len(vectors)) if i % 5 == 0]
    for g in got:
        own = first[prints[g.id].tobytes()]
        found = {c: brute(prints[own], prints[c]) for c in copies_of if c != own}
        found = {c: f for c, f in found.items() if f}
        assert (g.class_id, g.n_copies, g.n_classes, g.n_matches) == (own, copies_of[own] - 1, len(found), sum(copies_of[c] for c in found))
        if found:
            c = min(found, key=lambda c: (found[c][3] / found[c][2], c))
            assert (g.best_id, g.best_offset, g.best_bits, g.best_bit_errors) == (c, found[c][0], found[c][2], found[c][3])


def test_empty_short_and_null(spark):
    table = spark.createDataFrame([(0, None), (2, []), (4, [None, float("nan"), 0.1])], "id long, media array<float>")
    got = audio.search(table, F.col("id") >= 0, audio.decode_vector).collect()
    assert sorted(g.id for g in got) == [0, 2, 4] and {g.n_copies for g in got} == {2} and {g.best_id for g in got} == {None}
    assert audio.search(table.limit(0), F.col("id") >= 0, audio.decode_vector).count() == 0
    assert not len(audio.fingerprint(np.zeros(10))) and set(audio.fingerprint(np.zeros(200_000))) == {np.int32(audio.packed(np.zeros((LONG, 12)))[0]) for LONG in (audio.LONGEST,)}


def test_runs_of_equal_integers_vote_like_the_plain_histogram():
    r = np.random.default_rng(3)
    made = lambda n: np.repeat(r.integers(0, 4, n), r.integers(1, 9, n)).astype(np.int32)
    a, b = [made(r.integers(1, 12)) for _ in range(30)], [made(r.integers(1, 12)) for _ in range(40)]
    whole = lambda kind, xs, first: kind(np.arange(first, first + len(xs)), np.concatenate(xs), np.array(list(map(len, xs))))
    got = {}
    for batch in whole(audio.Block, a, 1000).matches(whole(audio.Recordings, b, 0), audio.VOTES, audio.OVERLAP, audio.ERRORS):
        got |= {(x["query"] - 1000, x["match"]): (x["offset"], x["votes"], x["bits"], x["bit_errors"]) for x in batch.to_pylist()}
    want = {(i, j): f for i, x in enumerate(a) for j, y in enumerate(b) if (f := brute(x, y))}
    assert got == want and len(want) > 100


def test_blocks_of_queries_and_hits_do_not_change_the_result(spark, monkeypatch):
    r = np.random.default_rng(7)
    rows = [(i, r.integers(0, 9, 27).astype(np.int32).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "class_id long, fp array<int>")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(audio.alignments(table, table))
    assert len(whole) > 20 and whole == key(audio.alignments(table, table, block_bytes=500))


def test_silence_is_linear():
    import time

    began = time.time()
    n = 1_000_000
    block = audio.Block(np.array([1]), np.zeros(n, np.int32), np.array([n]))
    out = [b for b in block.matches(audio.Recordings(np.array([2]), np.zeros(n // 2, np.int32), np.array([n // 2])), 1, 8, 0.25)]
    assert out[0].to_pylist() == [{"query": 1, "match": 2, "offset": 0, "votes": n // 2, "bits": 32 * (n // 2), "bit_errors": 0}] and time.time() - began < 20
