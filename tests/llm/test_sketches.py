"""Sketches by parity: none within the threshold is lost, and large sets that aren't alike are told apart."""

import random

import numpy as np
import pytest

from oakloom.llm.rings import ring_candidates, size_classes, sketch_widths, sketches, within_sketches


def drawn(seed, largest):
    """Pairs of sets, of which many are within the thresholds and some just beyond."""
    draw, sets = random.Random(seed), []
    for _ in range(150):
        a = {draw.getrandbits(62) for _ in range(draw.randint(1, largest))}
        b = {x for x in a if draw.random() < draw.choice([0.8, 0.9, 1])} | {draw.getrandbits(62) for _ in range(draw.choice([0, 1, largest // 10]))}
        sets += [a, b or a]
    return sets


@pytest.mark.parametrize("threshold,largest", [(0.6, 100), (0.7, 1000), (0.9, 5000)])
def test_sketches_lose_nothing(threshold, largest):
    sets = drawn(int(threshold * 10), largest)
    flat = np.array([x for s in sets for x in s], np.int64)
    owner, sizes = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([len(s) for s in sets], np.uint16)
    similar = [len(a & b) >= threshold * len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert any(similar) and not all(similar)
    for width in (256, 1024, 4096):
        columns = list(sketches(flat, owner, len(sets), width).T)
        i, j = within_sketches(sizes, columns, np.arange(0, len(sets), 2), np.arange(1, len(sets), 2), threshold)
        kept = set((i // 2).tolist())
        assert (j == i + 1).all() and all(k in kept for k, s in enumerate(similar) if s)


def test_the_largest_sizes_are_let_through():
    columns = list(np.array([[0], [2**64 - 1], [2**64 - 1]], np.uint64).T)
    i, j = within_sketches(np.array([65535, 3, 3], np.uint16), columns, np.array([0, 1, 0]), np.array([1, 2, 2]), 0.7)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 2)]


def test_sketches_are_about_as_wide_as_sets_are_large():
    ends = size_classes(0.7, 3000)
    widths = sketch_widths(ends)
    assert widths.min() == 256 and (widths >= np.minimum(ends, 4096)).all() and (widths % 64 == 0).all() and (np.diff(widths) >= 0).all()


def test_large_sets_that_differ_are_no_candidates(spark):
    """Sets of 320 of the same 600 words are of similarity 0.36; with one bitmap of 256 bits for all sizes each two that met were candidates."""
    draw = random.Random(5)
    words = [draw.getrandbits(62) for _ in range(600)]
    rows = [(k, sorted(draw.sample(words, 320))) for k in range(1, 201)]
    rows.append((999, sorted(rows[0][1][:310] + [draw.getrandbits(62) for _ in range(10)])))
    found = ring_candidates(spark.createDataFrame(rows, "node bigint, words array<bigint>"), np.zeros(0, np.uint64), 30_000, 0.7).collect()
    pairs = {(r.a, r.b) for r in found if r.b is not None}
    assert (1, 999) in pairs and len(pairs) < 400 and not [r for r in found if r.b is None]
