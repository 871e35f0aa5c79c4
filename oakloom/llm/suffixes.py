"""Suffix arrays over words: a sparse one over partitioned texts, whose intervals propose pairs, and one over pairs of texts for their shared spans.

The sparse array. Texts are sequences of word ids. A suffix is kept where the hash of its first three words is the
smallest among three neighbours in a row, and everywhere in texts of at most ``SHORT`` words; so every span of
five words that two texts share starts a kept suffix within itself, at the same place in both. Suffixes are ordered by the hashes of
their first three words, then of the next four, one after the other, and stand in buckets, which are ranges of that order.
An interval is a run of suffixes with a common prefix of three words.
"""

from __future__ import annotations

import numpy as np

WIDTH, SHORT = 3, 12
#: A suffix in one number: 36 bits of its first three words, then 7 bits for each of four more.
NEXT, BITS = 4, 7


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of two, by column; the order matters."""
    b = np.asarray(b).astype(np.uint64)
    x = (a.astype(np.uint64) ^ (b * np.uint64(0x9E3779B97F4A7C15) + (b >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def often(keys: np.ndarray, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that stand in more than the share of all, with their counts."""
    found, times = np.unique(keys, return_counts=True)
    kept = times > max(least, share * len(keys))
    return found[kept], times[kept]


def kept_suffixes(flat: np.ndarray, sizes: np.ndarray, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, prefix, order) of the kept suffixes of texts whose words stand one after the other in ``flat``.

    prefix: hash of the first three words, with the text's ``salt``; order: the number by which suffixes of one bucket are sorted.
    """
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(flat))
    padded = np.concatenate([flat, np.zeros(8, flat.dtype)])
    n = len(flat)
    first = flat if salt is None else mixed(flat, salt[owner]).view(np.int64)
    gram = mixed(mixed(first, padded[1 : n + 1]), padded[2 : n + 2])
    whole = left >= WIDTH
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.where(whole, gram, worst)
    far = np.concatenate([[worst] * 2, value, [worst] * 2])
    # positions beyond a text's ends count as larger, so that every window of a text has its smallest kept
    own = np.concatenate([[-1] * 2, owner, [-1] * 2])
    near = [np.where(own[2 + k : n + 2 + k] == owner, far[2 + k : n + 2 + k], worst) for k in (-2, -1, 1, 2)]
    low = (value <= near[0]) & (value <= near[1]) | (value <= near[1]) & (value <= near[2]) | (value <= near[2]) & (value <= near[3])
    at = np.flatnonzero(whole & (low | (sizes[owner] <= SHORT)))
    order = (gram[at] & np.uint64((1 << 36) - 1)) << np.uint64(NEXT * BITS)
    for k in range(NEXT):
        inside = left[at] > WIDTH + k
        word = np.where(inside, (padded[at + WIDTH + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS), 0)
        order |= word.astype(np.uint64) << np.uint64((NEXT - 1 - k) * BITS)
    return owner[at], gram[at], order


def cross_intervals(order: np.ndarray, side: np.ndarray, most: int | tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, large) of sorted suffixes: pairs of suffixes of side 0 and side 1 in one interval, and the suffixes of intervals of more pairs than ``most``.

    An interval is all suffixes with one prefix of three words. A large one is given out whole and not refined by further words, as lines
    that share the three may go on differently; its suffixes are to be compared by their bitmaps. ``most``: of several, the smallest.
    """
    value = order >> np.uint64(NEXT * BITS)
    start = np.r_[True, value[1:] != value[:-1]][: len(order)]
    run = np.cumsum(start) - 1
    ones = np.bincount(run, weights=side).astype(np.int64)
    zeros = np.bincount(run) - ones
    pairs = ones * zeros
    use = ((pairs > 0) & (pairs <= np.min(most)))[run]
    a, b = np.flatnonzero(use & (side == 0)), np.flatnonzero(use & (side == 1))
    times = zeros[run[b]]
    begin = np.searchsorted(run[a], run[b])
    within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return a[np.repeat(begin, times) + within], np.repeat(b, times), np.flatnonzero((pairs > np.min(most))[run])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key foremost."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class PairSuffixes:
    """One suffix array over many concatenated pairs of texts, each ended by a mark of its own.

    Built by prefix doubling; suffixes of one pair stand together. ``words`` holds all texts' word ids, first
    the left text of pair 0, then its right text, and so on; ``pair`` and ``right`` say whose each word is.
    """

    def __init__(self, words: np.ndarray, pair: np.ndarray, right: np.ndarray):
        n = len(words)
        text = pair * 2 + right
        self.pair, self.right = pair, right
        end = np.searchsorted(text, text, side="right")
        self.left_over = end - np.arange(n)
        self.levels = [_dense(pair, words)]
        width = 1
        while width < n and len(np.unique(self.levels[-1])) < n and width < self.left_over.max():
            rank = self.levels[-1]
            inside = self.left_over > width
            follow = np.full(n, -1, np.int64)
            follow[inside] = rank[np.flatnonzero(inside) + width]
            follow[~inside] = -1 - text[~inside]
            self.levels.append(_dense(rank, follow))
            width *= 2
        last = self.levels[-1]
        self.order = np.lexsort((np.arange(n), last))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and at j have in common from their start."""
        out = np.zeros(len(i), np.int64)
        most = np.minimum(self.left_over[i], self.left_over[j])
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + out, j + out
            fits = out + (1 << k) <= most
            same = fits.copy()
            same[fits] = self.levels[k][a[fits]] == self.levels[k][b[fits]]
            out[same] += 1 << k
        return out

    def longest_matches(self) -> np.ndarray:
        """For each word, the longest span from it that the pair's other text has too.

        Of all suffixes of the other text, the nearest before and after in the suffix array share the most.
        """
        n = len(self.order)
        best = np.zeros(n, np.int64)
        side, pair = self.right[self.order], self.pair[self.order]
        where = np.arange(n)
        for step in (1, -1):
            at, s, p = where[::step], side[::step], pair[::step]
            near = np.full(n, -1, np.int64)
            for other in (0, 1):
                seen = np.maximum.accumulate(np.where(s == other, np.arange(n), -1))
                near = np.where(s != other, seen, near)
            ok = near >= 0
            ok[ok] = p[near[ok]] == p[ok]
            i, j = self.order[at[ok]], self.order[at[near[ok]]]
            np.maximum.at(best, i, self.common(i, j))
        return best


def shared_spans(words: np.ndarray, pair: np.ndarray, right: np.ndarray, pairs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(covered, longest): for each pair and side the words covered by shared spans of at least ``least`` words, and the longest span."""
    best = PairSuffixes(words, pair, right).longest_matches()
    n = len(words)
    change = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(best >= least)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + best[starts], -1)
    covered = np.cumsum(change[:-1]) > 0
    counts = np.zeros((pairs, 2), np.int64)
    np.add.at(counts, (pair[covered], right[covered]), 1)
    longest = np.zeros(pairs, np.int64)
    np.maximum.at(longest, pair, best)
    return counts, longest
