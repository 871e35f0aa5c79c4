"""The ring index against brute force: it loses no pair of sets within the threshold."""

import random

import numpy as np
import pytest

from oakloom.llm import neardups, nearsets, rings
from oakloom.llm.neardups import near_duplicates, representative_pairs
from oakloom.llm.nearsets import close_rows
from oakloom.llm.rings import SURE, chain_budgets, chained, keys_of_size, ring_keys, run_pairs, segments_of, size_classes
from oakloom.llm.suffixes import mixed
from oakloom.llm.words import WordIds, id_array


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_similar_sets_meet_with_a_chain_within_budget(threshold):
    draw = random.Random(int(threshold * 100))
    for _ in range(300):
        base = {draw.getrandbits(62) for _ in range(draw.randint(1, 150))}
        other = {x for x in base if draw.random() > draw.choice([0, 0.1, 0.25])} | {draw.getrandbits(62) for _ in range(draw.choice([0, 1, 2, 9, 20]))}
        if not other or len(base & other) < max(SURE, threshold) * len(base | other):
            continue
        sizes = np.array([len(base), len(other)])
        owner, prefix, order = ring_keys(np.array([*sorted(base), *sorted(other)], np.int64), sizes, threshold)
        mine = dict(zip(prefix[owner == 0].tolist(), order[owner == 0].tolist()))
        theirs = dict(zip(prefix[owner == 1].tolist(), order[owner == 1].tolist()))
        shared = mine.keys() & theirs.keys()
        assert any(chained(np.array([mine[k]], np.uint64), np.array([theirs[k]], np.uint64), chain_budgets(threshold))[0] for k in shared)
        assert [int((owner == k).sum()) for k in (0, 1)] == keys_of_size(sizes, threshold).tolist()


def test_classes_hold_similar_sizes():
    ends = size_classes(0.7, 5000)
    assert (np.diff(segments_of(ends, 0.7)) >= 0).all()
    for n in range(1, 4000, 3):
        for m in range(n, int(n / 0.7) + 1):
            if n >= 0.7 * m:
                assert np.searchsorted(ends, m) - np.searchsorted(ends, n) <= 1


def test_runs_give_all_pairs_or_are_hot():
    draw = np.random.default_rng(4)
    order = np.sort(draw.integers(0, 40, 900).astype(np.uint64) << np.uint64(28) | draw.integers(0, 4, 900).astype(np.uint64) << np.uint64(21))
    left, right, hot = run_pairs(order, (20, 20, 20, 20, 20))
    got = set(zip(left.tolist(), right.tolist())) | {(i, j) for i in hot.tolist() for j in hot.tolist()}
    assert all((i, j) in got for i in range(900) for j in range(i + 1, 900) if order[i] == order[j])


def test_all_rarer_words_replaced(spark):
    draw, rows = random.Random(1), []
    for k in range(400):
        words = [f"c{x}" for x in draw.sample(range(400), 40)]
        for side in (0, 1):
            rows.append((2 * k + side, " ".join(words[:10]), " ".join(words[10:] + [f"r{draw.getrandbits(60)}" for _ in range(4)])))
    groups = {}
    for r in near_duplicates(spark.createDataFrame(rows, "sample_id bigint, prompt string, response string")).collect():
        groups.setdefault(r.group_id, set()).add(r.sample_id)
    assert {frozenset(g) for g in groups.values()} == {frozenset((2 * k, 2 * k + 1)) for k in range(400)}


def test_representatives_stand_for_all_pairs(spark):
    rows = [(1, "g", 1, 1), (2, "g", 1, 1), (3, "g", 2, 1), (4, "g", 3, 1), (5, "h", 4, 1), (6, "h", 4, 1)]
    got = {tuple(r) for r in representative_pairs(spark.createDataFrame(rows, "sample_id bigint, group_id string, key_a bigint, key_b bigint")).collect()}
    assert got == {("g", 1, 3, 1), ("g", 1, 4, 1)}


@pytest.mark.parametrize("large,family", [(100_000, 16), (100_000, 0), (16, 16)])
def test_segments_that_many_hold(spark, monkeypatch, large, family):
    """Records differ in the words of one segment only; some two of them are alike, and meet in segments that all records hold."""
    monkeypatch.setattr(neardups, "LARGE", large, raising=False)
    monkeypatch.setattr(rings, "FAMILY", family, raising=False)
    ends, n = size_classes(0.7, 30), 30
    one, two = segments_of(ends, 0.7)[np.searchsorted(ends, n) + np.arange(2)].tolist()
    draw = random.Random(9)
    names = [f"w{draw.getrandbits(60)}" for _ in range(300_000)]
    place = (mixed(id_array(names, WordIds()), 7) >> np.uint64(32)).astype(np.float64) / 2**32
    inside = (place * one).astype(int) == 1
    pieces = [[names[k] for k in np.flatnonzero(inside & ((place * two).astype(int) == p))] for p in np.unique((place[inside] * two).astype(int))]
    every = [names[k] for k in np.flatnonzero(~inside)[:16]]
    rows, planted = [], set()
    for k in range(0, 600, 2):
        own = [[piece.pop() for _ in range(14 // len(pieces))] for piece in pieces]
        if k % 60 == 0:
            other = [x[1:] + [piece.pop()] for x, piece in zip(own, pieces)]
            planted.add(frozenset((k, k + 1)))
        else:
            other = [[piece.pop() for _ in x] for x, piece in zip(own, pieces)]
        rows += [(k + s, " ".join(every), " ".join(w for x in t for w in x)) for s, t in enumerate((own, other))]
    groups = {}
    for r in near_duplicates(spark.createDataFrame(rows, "sample_id bigint, prompt string, response string")).collect():
        groups.setdefault(r.group_id, set()).add(r.sample_id)
    assert {frozenset(g) for g in groups.values()} == planted


def test_rows_of_a_run_are_compared_once(monkeypatch):
    monkeypatch.setattr(nearsets, "BLOCK", 50)
    draw = np.random.default_rng(6)
    n = np.append(draw.integers(1, 40, 200), [65535, 65535, 3]).astype(np.uint16)
    bits, rows = draw.integers(0, 1 << 20, 203).astype(np.uint32), np.arange(203)
    got = [(min(i, j), max(i, j)) for x, y in close_rows(rows, rows, n, [bits], np.full(203, 8, np.uint8), 0.75, within=True) for i, j in zip(x.tolist(), y.tolist())]
    m = n.astype(float)
    fits = (np.bitwise_count(bits[:, None] ^ bits) <= 8) & (np.minimum(m[:, None], m) >= 0.75 * np.maximum(m[:, None], m) - 1e-6) | (n == 65535)[:, None] | (n == 65535)
    assert len(got) == len(set(got)) and {(int(x), int(y)) for x, y in zip(*np.nonzero(fits)) if x < y} <= set(got)
