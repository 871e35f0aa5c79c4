"""Frequent words dealt to segments: nothing similar is lost, and runs of equal keys are shorter."""

import random

import numpy as np

from oakloom.llm import rings
from oakloom.llm.rings import chain_budgets, chained, dealt_words, ring_suffixes


def drawn(n):
    """Sets of 60 words, most of them of a few hundred frequent ones of very different frequency; every tenth is like the one before."""
    draw, sets = random.Random(3), []
    common, weights = [draw.getrandbits(62) for _ in range(300)], [1 / (k + 2) for k in range(300)]
    for k in range(n):
        own = set(draw.choices(common, weights, k=90)) | {draw.getrandbits(62) for _ in range(4)}
        if k % 10 == 9:
            own = set(draw.sample(sorted(sets[-1]), int(len(sets[-1]) * 0.9))) | {draw.getrandbits(62)}
        sets.append(own)
    return sets


def runs(prefix):
    times = np.unique(prefix, return_counts=True)[1]
    return int((times * (times - 1) // 2).sum()), int(times.max())


def test_dealt_words_shorten_runs_and_lose_nothing():
    sets = drawn(4000)
    flat, sizes = np.array([x for s in sets for x in s], np.int64), np.array([len(s) for s in sets])
    dealt = dealt_words(flat, sizes, 0.7)
    assert (np.diff(dealt[0]) > 0).all() and dealt[1].shape[1] == len(dealt[0])
    owner, prefix, order, _ = ring_suffixes(flat, sizes, 0.7, dealt)
    (pairs, longest), (before, longest_before) = runs(prefix), runs(ring_suffixes(flat, sizes, 0.7)[1])
    assert pairs < 0.7 * before and longest < longest_before
    of = {}
    for o, p, x in zip(owner.tolist(), prefix.tolist(), order.tolist()):
        of.setdefault(o, {})[p] = x
    alike = [(k - 1, k) for k in range(9, 4000, 10) if len(sets[k] & sets[k - 1]) >= 0.8 * len(sets[k] | sets[k - 1])]
    assert len(alike) > 300
    for a, b in alike:
        assert any(chained(np.array([of[a][p]], np.uint64), np.array([of[b][p]], np.uint64), chain_budgets(0.7))[0] for p in of[a].keys() & of[b].keys())


def test_few_sets_are_cut_by_hash():
    assert dealt_words(np.arange(50), np.full(10, 5), 0.7) is None
    assert len(rings.ring_keys(np.arange(50), np.full(10, 5), 0.7)) == 3
