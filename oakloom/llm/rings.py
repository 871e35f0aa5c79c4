"""Rings of segments over word sets: pigeonring as an index.

Sets of m and n words whose similarity is at least t differ in at most (m + n)(1 - t)/(1 + t) words. Sets are put into
classes by size, such that those of similarity ``threshold`` are of one class or of neighbouring ones. A class has a ring of D + 1
segments, D being the most words in which two sets up to its largest size differ at the similarity ``SURE``; each word belongs to one segment: a frequent one
to that to which it was dealt, so that few sets agree by chance on any segment, others by their hash.

Pigeonring: of D differences on D + 1 segments there is a segment from which, for every l, the first l segments hold at most
l - 1 of them. That segment is equal in both sets, so its words are the key under which they meet. Sets that differ more, down to the threshold, have in
proportion more differences on each segment, so chains of l segments are given that budget: the next four segments are tested one by one
before sketches of whole sets are. No pair of similarity SURE or more is lost by that; one between threshold and SURE is where none of its equal segments
starts such a chain. A suffix of the ring in one number: 36 bits of its key, then for each of the next four segments the bits that its words set out of seven.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oakloom.llm.nearsets import close_rows
from oakloom.llm.suffixes import BITS, NEXT, mixed
from oakloom.llm.words import list_parts, map_batches

#: Pairs up to which runs are paired up together and not one by one; keys of a bucket; least and most bits of the sketches sent there; keys of a run that
#: are one task's; pairs of a run for each of its rows beyond which it is one for hubs.
PAIRS, BUCKET, SKETCH, WIDEST, LARGE, FAMILY = 1000, 2_000_000, 256, 4096, 100_000, 16
#: Words are dealt by about so many sets of at most so many words, and by so many pairs of them in each class, if there are a quarter of these sets; of words in
#: at least this share of the sets the most frequent.
DEALT_BY, DEALT_SIZE, DEALT_PAIRS, DEALT_SHARE, DEALT_WORDS = 4000, 2000, 1 << 14, 0.003, 2000
SURE = 0.8
_LOW = np.uint64((1 << NEXT * BITS) - 1)
#: What is sent of a ring suffix: 28 bits of its key, enough within a bucket, and those of the next segments.
_SENT = np.uint64((1 << 28 + NEXT * BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def size_classes(threshold: float, largest: int) -> np.ndarray:
    """The largest sizes of the classes, up to one that holds ``largest`` and one more."""
    ends = [1]
    while ends[-1] < largest or len(ends) < 2:
        ends.append(max(ends[-1] + 1, int(ends[-1] / threshold)))
    return np.array(ends + [max(ends[-1] + 1, int(ends[-1] / threshold))])


def segments_of(ends: np.ndarray, threshold: float) -> np.ndarray:
    """Segments of the ring of each class."""
    sure = max(SURE, threshold)
    return np.floor(2 * ends * ((1 - sure) / (1 + sure)) + 1e-9).astype(np.int64) + 1


def chain_budgets(threshold: float) -> list[int]:
    """The most differences in the first 2, 3, 4 and 5 segments of a chain that starts with an equal one."""
    sure = max(SURE, threshold)
    more = (1 - threshold) / (1 + threshold) / ((1 - sure) / (1 + sure))
    return [max(length - 1, int(length * more + 1e-9)) if more > 1 else length - 1 for length in range(2, NEXT + 2)]


def dealt_words(flat: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Frequent words in order, and the segment of each in the ring of each class, -1 where its hash tells; from some of the sets.

    Each goes to the segment in which it tells most pairs of sets apart that agree there in all words dealt before. Any way to deal words is right; this one makes
    runs of equal keys short. Without it segments to which few frequent words fall are equal in many sets.
    """
    if len(sizes) < DEALT_BY // 4:
        return None
    word, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times >= DEALT_SHARE * len(sizes))
    some = some[np.argsort(-times[some], kind="stable")[:DEALT_WORDS]]
    rank = np.full(len(word), -1)
    rank[some] = np.arange(len(some))
    known = rank[place] >= 0
    has = np.zeros((len(some), len(sizes)), bool)
    has[rank[place[known]], np.repeat(np.arange(len(sizes)), sizes)[known]] = True
    ends = size_classes(threshold, int(sizes.max()))
    table = np.full((len(ends), len(some)), -1, np.int16)
    draw = np.random.default_rng(7)
    for kind, parts in enumerate(segments_of(ends, threshold).tolist()):
        near = np.flatnonzero((sizes <= ends[kind]) & (sizes >= threshold**2 * ends[kind]))
        if parts < 2 or len(near) < 50:
            continue
        one = draw.integers(len(near), size=DEALT_PAIRS)
        two = (one + draw.integers(1, len(near), size=DEALT_PAIRS)) % len(near)
        differ = np.ascontiguousarray(np.packbits(has[:, near[one]] != has[:, near[two]], axis=1)).view(np.uint64)
        equal = np.full((parts, DEALT_PAIRS // 64), ~np.uint64(0))
        for w in range(len(some)):
            to = int(np.bitwise_count(equal & differ[w]).sum(axis=1).argmax())
            table[kind, w] = to
            equal[to] &= ~differ[w]
    by = np.argsort(word[some])
    return word[some][by], table[:, by]


def sketch_widths(ends: np.ndarray) -> np.ndarray:
    """Bits of the sketches of each class, at least as many as its sets have words (but for WIDEST), as fuller sketches tell little."""
    return np.clip(1 << np.ceil(np.log2(1.05 * ends)).astype(np.int64), SKETCH, WIDEST)


def sketches(flat: np.ndarray, owner: np.ndarray, rows: int, width: int) -> np.ndarray:
    """(rows, width / 64) of uint64: of each bit, whether an odd number of the set's words fall on it.

    A bit in which two sets differ needs a word that only one of them has, as with bitmaps; but a word that both have hides none.
    """
    at = ((flat.astype(np.uint64) * _MIX) >> np.uint64(65 - width.bit_length())).astype(np.int64)
    out = np.zeros((rows, width // 64), np.uint64)
    np.bitwise_xor.at(out, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def within_sketches(sizes: np.ndarray, columns: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) whose sizes and sketches leave the similarity possible; those of 65535 words or more are let through.

    columns: 64 bits of all sketches each. A pair is dropped once those tested so far differ too much.
    """
    budget = np.where(sizes == 65535, np.inf, sizes * ((1 - threshold) / (1 + threshold)))
    most = budget[i] + budget[j] + 1e-6
    differ = np.zeros(len(i), np.int16)
    for k, bits in enumerate(columns, 1):
        differ += np.bitwise_count(bits[i] ^ bits[j])
        if k % 2 == 0 or k == len(columns):
            left = np.flatnonzero(differ <= most)
            i, j, most, differ = i[left], j[left], most[left], differ[left]
    m, o = sizes[i].astype(np.int64), sizes[j].astype(np.int64)
    left = (np.minimum(m, o) >= threshold * np.maximum(m, o) - 1e-6) | (np.maximum(m, o) == 65535)
    return i[left], j[left]


def ring_keys(flat: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, prefix, order) of the segments of sets whose distinct words stand one after the other in ``flat``.

    Each set is cut by the ring of its class, and by the next larger one's if a set of that class may be similar. prefix: hash of
    class, segment and its words; order: see above.
    """
    return ring_suffixes(flat, sizes, threshold)[:3]


def ring_suffixes(flat: np.ndarray, sizes: np.ndarray, threshold: float, dealt: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ring_keys`` and the width of the sketches of each segment's class; ``dealt``: the segments of frequent words."""
    ends = size_classes(threshold, int(sizes.max(initial=1)))
    parts = segments_of(ends, threshold)
    own = np.searchsorted(ends, sizes)
    rows = np.flatnonzero(sizes > 0)
    above = rows[sizes[rows] >= threshold * (ends[own[rows]] + 1) - 1e-9]
    set_of = np.concatenate([rows, above])
    kind = np.concatenate([own[rows], own[above] + 1])
    count = parts[kind]
    begin = np.cumsum(count) - count
    total = int(count.sum())
    starts = np.cumsum(sizes) - sizes
    each = sizes[set_of]
    many = int(each.sum())
    place = np.repeat(starts[set_of] - (np.cumsum(each) - each), each) + np.arange(many)
    spread = mixed(flat, 7)[place]
    segment = ((spread >> np.uint64(32)) * np.repeat(count, each).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    if dealt is not None and len(dealt[0]):
        frequent, table = dealt
        word = np.searchsorted(frequent, flat)
        word[word == len(frequent)] = 0
        word = np.where(frequent[word] == flat, word, -1)[place]
        known = np.flatnonzero((word >= 0) & (np.repeat(kind, each) < len(table)))
        to = table[np.repeat(kind, each)[known], word[known]]
        segment[known[to >= 0]] = to[to >= 0]
    at = np.repeat(begin, each) + segment
    said = np.zeros(total, np.uint64)
    np.add.at(said, at, mixed(flat, 11)[place])
    grid = np.zeros(total * 8, np.uint8)
    grid[at * 8 + 1 + ((spread & np.uint64(0xFFFF)) * np.uint64(BITS) >> np.uint64(16)).astype(np.int64)] = 1
    bits = np.packbits(grid.reshape(-1, 8), axis=1)[:, 0].astype(np.uint64)
    ring = np.repeat(np.arange(len(set_of)), count)
    number = np.arange(total) - begin[ring]
    prefix = mixed(mixed(said, number), kind[ring])
    order = (prefix & np.uint64((1 << 36) - 1)) << np.uint64(NEXT * BITS)
    for k in range(NEXT):
        # a ring shorter than the chain doesn't meet itself
        follow = bits[begin[ring] + (number + k + 1) % count[ring]]
        order |= np.where(k + 1 < count[ring], follow, 0).astype(np.uint64) << np.uint64((NEXT - 1 - k) * BITS)
    return set_of[ring], prefix, order, sketch_widths(ends)[kind[ring]]


def keys_of_size(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The number of keys of a set of each size."""
    ends = size_classes(threshold, int(sizes.max(initial=1)))
    parts, own = segments_of(ends, threshold), np.searchsorted(ends, sizes)
    return parts[own] + np.where(sizes >= threshold * (ends[own] + 1) - 1e-9, parts[own + 1], 0)


def chained(a: np.ndarray, b: np.ndarray, budgets: list[int]) -> np.ndarray:
    """Which pairs of ring suffixes with equal keys keep to the budgets of the next segments."""
    differ = (a ^ b) & a.dtype.type(_LOW)
    alive = np.ones(len(a), bool)
    for length, budget in enumerate(budgets, 1):
        alive &= np.bitwise_count(differ >> a.dtype.type((NEXT - length) * BITS)) <= budget
    return alive


def run_pairs(order: np.ndarray, most: int | tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, large) of sorted ring suffixes: the pairs of each run of equal keys, and the rows of runs of more pairs than ``most``.

    A large run is given out whole and not refined by equal further segments, as similar sets may differ there within their budgets; its rows are
    to be compared by chains. ``most``: of several, the smallest.
    """
    value = order >> np.uint64(NEXT * BITS)
    start = np.flatnonzero(np.r_[True, value[1:] != value[:-1]][: len(order)])
    length = np.diff(np.r_[start, len(order)])
    fits = np.repeat(length * (length - 1) // 2 <= np.min(most), length)
    times = np.where(fits, np.arange(len(order)) - np.repeat(start, length), 0)
    right = np.repeat(np.arange(len(order)), times)
    left = right - 1 - (np.arange(len(right)) - np.repeat(np.cumsum(times) - times, times))
    return left, right, np.flatnonzero(~fits)


_BLOCK = "bucket int, width int, hot boolean, orders binary, who binary, nodes binary, sizes binary, bits binary"


def _blocks(lists: DataFrame, hot: np.ndarray, dealt: tuple[np.ndarray, np.ndarray] | None, buckets: int, threshold: float) -> DataFrame:
    """Rows of ``_BLOCK``: of each batch, the ring suffixes of a bucket and a width of sketches with a table of their nodes.

    ``orders`` has a byte of all of them after the other, from the highest on. A key that is ``hot`` isn't compared in a bucket: its rows are to be resolved by hubs.
    """
    sent = lists.sparkSession.sparkContext.broadcast((hot, dealt))

    def work(batch):
        out = {c: [] for c in ("bucket", "width", "hot", "orders", "who", "nodes", "sizes", "bits")}
        flat, owner = list_parts(batch, "words")
        node, n = batch.column("node").to_numpy(), np.bincount(owner, minlength=batch.num_rows)
        hot, dealt = sent.value
        who, prefix, order, width = ring_suffixes(flat, n, threshold, dealt)
        bits = {}
        full = np.isin(prefix, hot)
        place = np.where(full, mixed(node[who], 5), prefix)
        bucket = ((place >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        group = (bucket * 2 + full) * 2 * WIDEST + width
        by = np.lexsort((order & _SENT, group))
        group = group[by]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        for lo, hi in zip(first, np.r_[first[1:], len(group)]):
            part = by[lo:hi]
            lines, local = np.unique(who[part], return_inverse=True)
            if len(lines) > 65535:
                raise ValueError("too many rows in a batch")
            wide = int(width[part[0]])
            if wide not in bits:
                has = np.bincount(who[width == wide], minlength=batch.num_rows) > 0
                row = np.cumsum(has) - 1
                bits[wide] = row, sketches(flat[has[owner]], row[owner[has[owner]]], int(has.sum()), wide)
            out["bucket"].append(int(bucket[part[0]]))
            out["width"].append(wide)
            out["hot"].append(bool(full[part[0]]))
            out["orders"].append((order[part] & _SENT).astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes())
            out["who"].append(local.astype(np.uint16).tobytes())
            out["nodes"].append(node[lines].tobytes())
            out["sizes"].append(np.minimum(n[lines], 65535).astype(np.uint16).tobytes())
            out["bits"].append(bits[wide][1][bits[wide][0][lines]].tobytes())
        return out

    return map_batches(lists.select("node", "words"), work, _BLOCK)


def _orders(sent: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(sent, np.uint8).reshape(8, -1).T).view(">u8")[:, 0].astype(np.uint64)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def ring_candidates(lists: DataFrame, hot: np.ndarray, keys: int, threshold: float, dealt: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(a, b, key): pairs of nodes that meet under a key and whose chains keep to their budgets, key null; and, b null, the nodes of keys that are to be resolved by hubs.

    These are the ``hot`` ones and those of more than ``FAMILY`` such pairs for each row.

    lists: (node, words), the distinct words of each node; ``keys``: about how many keys they have together; ``dealt``: the segments of frequent words.
    """
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(-(-parts // 2), -(-keys // BUCKET))
    budgets = chain_budgets(threshold)

    def bucket_rows(held):
        order, who, nodes, n, bits = [], [], [], [], []
        seen = 0
        for row in held:
            own = np.frombuffer(row["nodes"], np.int64)
            local = np.frombuffer(row["who"], np.uint16).astype(np.int64)
            if row["hot"]:
                yield own[local], None, (_orders(row["orders"]) >> np.uint64(NEXT * BITS)).astype(np.int64)
                continue
            order.append(_orders(row["orders"]))
            who.append((local + seen).astype(np.int32))
            nodes.append(own)
            n.append(np.frombuffer(row["sizes"], np.uint16))
            bits.append(np.frombuffer(row["bits"], np.uint64).reshape(-1, row["width"] // 64))
            seen += len(own)
        if not order:
            return
        bucket_key = held[0]["bucket"] + 1 << 28
        held.clear()
        order, who, nodes, n, bits = (np.concatenate(x) for x in (order, who, nodes, n, bits))
        by = np.argsort(order, kind="stable")
        order, who = order[by], who[by]
        del by
        nodes, place = np.unique(nodes, return_inverse=True)
        bits = [np.ascontiguousarray(x) for x in bits.T]

        def met(x, y, marks, who, sizes, columns, ids):
            """Pairs of rows that keep to the chain's budgets and to the whole one, each in one number; ids: the nodes of what ``who`` stands for."""
            keep = chained(marks[x], marks[y], budgets)
            x, y = within_sketches(sizes, columns, who[x[keep]], who[y[keep]], threshold)
            a, b = ids[x], ids[y]
            return (np.minimum(a, b) * len(nodes) + np.maximum(a, b))[a != b]

        def once(found):
            a, b = np.divmod(np.unique(np.concatenate(found)), len(nodes))
            return nodes[a], nodes[b], None

        left, right, large = run_pairs(order, PAIRS)
        found, many = [], 0
        for at in range(0, len(left), 1_000_000):
            found.append(met(left[at : at + 1_000_000], right[at : at + 1_000_000], order, who, n, bits, place))
        del left, right
        value = order[large] >> np.uint64(NEXT * BITS)
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]][: len(value)])
        for lo, hi in zip(first.tolist(), np.r_[first[1:], len(value)].tolist()):
            some = large[lo:hi]
            some = some[np.argsort(n[who[some]], kind="stable")]
            rows, at = np.arange(hi - lo), who[some]
            # copies of the run's own, which stay in a processor's cache
            marks, ids, sizes, columns = (order[some] & _LOW).astype(np.uint32), place[at], n[at], [x[at] for x in bits]
            own, all_pairs = [], 0
            for x, y in close_rows(rows, rows, sizes, [marks], np.full(len(rows), budgets[-1], np.uint8), threshold, within=True):
                own.append(met(x, y, marks, rows, sizes, columns, ids))
                all_pairs += len(own[-1])
                if all_pairs > FAMILY * (hi - lo):
                    break
            if all_pairs > FAMILY * (hi - lo):
                ids = np.unique(ids)
                yield nodes[ids], None, np.full(len(ids), value[lo].astype(np.int64) + bucket_key)
                continue
            found += own
            many += all_pairs
            if many > 2_000_000:
                yield once(found)
                found, many = [], 0
        if found:
            yield once(found)

    def scan(batches):
        held, current = [], (None, None)

        def flush():
            for columns in bucket_rows(held):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), t.type) if c is None else pa.array(c, t.type) for c, t in zip(columns, _FOUND)], schema=_FOUND)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["width"]) != current:
                    yield from flush()
                    held, current = [], (row["bucket"], row["width"])
                held.append(row)
        yield from flush()

    return _blocks(lists, hot, dealt, buckets, threshold).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "width").mapInArrow(scan, "a bigint, b bigint, key bigint")
