"""Similar word sets: bitmaps, large keys, components; shared machinery of problems 1 and 3.

A node is a class of texts with the same words; its id is a 64-bit hash. Keys that two similar nodes share
bring them together; the pigeonring filter then drops pairs whose bitmaps prove that they differ too much.

Bitmap: each distinct word sets one of 128 bits in one of 8 segments on a ring. A bit that differs needs at
least one word that only one side has, so the number of differing bits is at most the symmetric difference
of the word sets, in each segment and in all. Sets of sizes m and n whose similarity is t or more differ in
at most d = (m + n)(1 - t)/(1 + t) words. Pigeonring: then there is a segment from which, for every l, the
first l segments differ in at most l*d/8 bits together. Pairs without such a chain are dropped before the
words themselves are compared; none within the threshold is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oakloom.llm.storage import dropped, written
from oakloom.llm.words import map_batches

SEGMENTS = 8
WIDTH = 1024
#: Pairs that are compared at once.
BLOCK = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bitmaps(flat: np.ndarray, owner: np.ndarray, rows: int, width: int = WIDTH) -> np.ndarray:
    """(rows, width / 64) of uint64: the bitmaps of sets given by their words' ids and owners."""
    at = ((flat.astype(np.uint64) * _MIX) >> np.uint64(65 - width.bit_length())).astype(np.int64)
    out = np.zeros((rows, width // 64), np.uint64)
    np.bitwise_or.at(out, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def bit_column(bits: np.ndarray) -> pa.Array:
    """Bitmaps as a column of binary values."""
    data = np.ascontiguousarray(bits)
    ends = (np.arange(len(data) + 1) * data.shape[1] * 8).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def bit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The bitmaps of a column of binary values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, WIDTH // 64), np.uint64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(len(column), -1)


def within_bits(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sizes and bitmaps leave the similarity possible; texts of 65535 words or more are let through."""
    m = n.astype(np.int64)
    total = m[i] + m[j]
    ok = np.minimum(m[i], m[j]) >= threshold * np.maximum(m[i], m[j]) - 1e-6
    ok |= np.maximum(m[i], m[j]) == 65535
    at = np.flatnonzero(ok)
    differ = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1)
    ok[at] = differ <= total[at] * ((1 - threshold) / (1 + threshold)) + 1e-6
    return ok | (np.maximum(m[i], m[j]) == 65535)


def close_rows(a: np.ndarray, b: np.ndarray, n: np.ndarray, marks: list[np.ndarray], most: np.ndarray, threshold: float, within: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches (i, j): all rows of ``a`` with rows of ``b`` whose sizes leave the similarity possible and whose ``marks`` differ in at most ``most[i]`` bits.

    n: the size of each row; marks: its bits, as one or more columns of numbers. With ``within``, a and b are the same rows, of which each two are compared once. Sizes of 65535 stand for larger ones too and are let through. Of each two rows
    nothing but the result is kept, a block at a time that fits a processor's cache.
    """
    size = n.astype(np.int64)
    for x, y in ((a[size[a] >= 65535], b[size[b] >= 65535] if within else b), (a[size[a] < 65535], b[size[b] >= 65535])):
        step = max(1, BLOCK // max(1, len(y)))
        for at in range(0, len(x) if len(y) else 0, step):
            some = x[at : at + step]
            i, j = np.repeat(some, len(y)), np.tile(y, len(some))
            keep = (i < j) | (size[i] < 65535) if within else slice(None)
            yield i[keep], j[keep]
    a, b = (x[size[x] < 65535] for x in (a, b))
    a, b = a[np.argsort(size[a], kind="stable")], b[np.argsort(size[b], kind="stable")]
    own, other, left, right, most = size[a], size[b], [m[a, None] for m in marks], [m[b] for m in marks], most[a, None]
    low = np.arange(len(a)) + 1 if within else np.searchsorted(other, threshold * own - 1e-6)
    high = np.searchsorted(other, own / threshold + 1e-6, side="right")
    at = 0
    while at < len(a):
        end = at + max(1, min(len(a) - at, BLOCK // max(1, int(high[at] - low[at]))))  # windows move on but slowly
        others = slice(int(low[at]), int(high[end - 1]))
        differ = np.bitwise_count(left[0][at:end] ^ right[0][others])
        for one, two in zip(left[1:], right[1:]):
            differ += np.bitwise_count(one[at:end] ^ two[others])
        found = np.flatnonzero(differ <= most[at:end])
        if len(found):
            x, y = np.divmod(found, differ.shape[1])
            if within:
                once = y >= x
                x, y = x[once], y[once]
            yield a[at:end][x], b[others][y]
        at = end


def within_ring(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of bitmaps have a chain within the budgets. a, b: rows of bitmaps; sizes: m + n of each pair.

    Chains grow by a segment at a time from every start; a pair is dropped once none of its chains is left. The chain of
    all segments is the full Hamming check.
    """
    most = sizes * ((1 - threshold) / (1 + threshold))
    at = np.arange(len(most))
    total, alive = np.zeros((len(at), SEGMENTS)), np.ones((len(at), SEGMENTS), bool)
    differ = np.bitwise_count(a ^ b).reshape(len(at), SEGMENTS, -1).sum(axis=2).astype(np.float64)
    for length in range(1, SEGMENTS + 1):
        total += np.roll(differ, 1 - length, axis=1)
        alive &= total <= (most[at] * (length / SEGMENTS))[:, None] + 1e-6
        left = alive.any(axis=1)
        at, total, alive, differ = at[left], total[left], alive[left], differ[left]
    out = np.zeros(len(most), bool)
    out[at] = True
    return out


def _run_pairs(key: np.ndarray, node: np.ndarray, side: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within each run of equal keys; with ``cross`` only those of side 0 with side 1, in this order."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[first, len(key)])
    for size in np.unique(length[length > 1]):
        i, j = np.triu_indices(int(size), 1)
        starts = first[length == size]
        step = max(1, 2_000_000 // len(i))
        for at in range(0, len(starts), step):
            base = starts[at : at + step, None]
            x, y = (base + i).ravel(), (base + j).ravel()
            a, b = node[x], node[y]
            keep = a != b
            if cross:
                keep &= side[x] != side[y]
                swap = side[x] > side[y]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
            else:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield a[keep], b[keep]


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("side", pa.int32())])


def _as_batch(a: np.ndarray, b: np.ndarray | None = None, key: np.ndarray | None = None, side: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [pa.array(c, t.type) if c is not None else pa.nulls(len(a), t.type) for c, t in zip((a, b, key, side), _OUT)]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def _scan_runs(most: int, cross: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        hot = None

        def flush(parts):
            key, node, side = parts
            for a, b in _run_pairs(key, node, side, cross):
                if len(a):
                    yield _as_batch(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, side = (np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "node", "side")))
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (side[1:] != side[:-1])]
            key, node, side = key[new], node[new], side[new]
            if hot is not None:
                n = int(np.searchsorted(key != hot, True)) if key[-1] != hot else len(key)
                if n:
                    yield _as_batch(node[:n], None, key[:n], side[:n])
                    key, node, side = key[n:], node[n:], side[n:]
                if not len(key):
                    held = [key, node, side]
                    continue
                hot = None
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[first, len(key)])
            large = np.repeat(length > most, length)
            last = np.arange(len(key)) >= first[-1]
            if large.any():
                yield _as_batch(node[large], None, key[large], side[large])
            if length[-1] > most:
                hot = key[-1]
                held = [x[:0] for x in held]
            else:
                held = [key[last], node[last], side[last]]
            done = ~large & ~last
            yield from flush((key[done], node[done], side[done]))
        if len(held[0]):
            yield from flush(held)

    return scan


def key_runs(keys: DataFrame, cross: bool, most: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, hot): all pairs (a, b) of keys with at most ``most`` rows, and the rows (key, node, side) of the others.

    keys: (key bigint, node bigint, side int). With ``cross``, a is of side 0 and b of side 1; else a < b. A run of
    equal keys streams through its task and is never held beyond ``most`` rows.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = keys.repartition(parts, "key").sortWithinPartitions("key", "node", "side").mapInArrow(_scan_runs(most, cross), "a bigint, b bigint, key bigint, side int")
    found = written(runs, "runs")
    return found.where("key is null").select("a", "b"), found.where("key is not null").selectExpr("key", "a as node", "side")


def pruned(pairs: DataFrame, bitmap: DataFrame, threshold: float) -> DataFrame:
    """(a, b), each once: the pairs that pass the pigeonring filter. bitmap: (node, n, bits), one row per node."""
    left = bitmap.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("abits"))
    right = bitmap.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bbits"))

    def prune(batch):
        keep = within_ring(bit_rows(batch.column("abits")), bit_rows(batch.column("bbits")), batch.column("na").to_numpy() + batch.column("nb").to_numpy(), threshold)
        return {"a": batch.column("a").to_numpy()[keep], "b": batch.column("b").to_numpy()[keep]}

    return map_batches(pairs.distinct().join(left.hint("merge"), "a").join(right.hint("merge"), "b"), prune, "a bigint, b bigint")


def candidate_pairs(keys: DataFrame, bitmap: DataFrame, threshold: float, cross: bool, most: int = 256, block: int = 1024) -> DataFrame:
    """(a, b), each once: nodes that share a key and pass the pigeonring filter.

    Keys with more than ``most`` rows are cut into blocks of about ``block`` rows; each two blocks of a key meet in a
    group of their own, where the filter runs before any pair is emitted. So no key is dropped, and none is held by one task.
    """
    pairs, hot = key_runs(keys, cross, most)
    if hot.take(1):
        pairs = pairs.unionByName(_hot_pairs(hot, bitmap, threshold, cross, block))
    return pruned(pairs, bitmap, threshold)


def linked_components(keys: DataFrame, bitmap: DataFrame, threshold: float, verified, known: DataFrame, most: int = 512, block: int = 1024) -> DataFrame:
    """(node, label) of the components of nodes that share a key, pass the filter and are ``verified``, or are linked by the ``known`` edges (a, b).

    ``verified`` maps a frame of pairs (a, b) to those that are links. Keys with more than ``most`` rows give no
    pairs at first: their rows are compared with one of them, the hub, so that a large group of alike
    nodes becomes one component by as many comparisons as it has members. What stays in other components is then compared with
    all rows of its key that aren't in its own, in blocks. So every link between components is found, and
    no group is paired up within itself.
    """
    pairs, hot = key_runs(keys, False, most)
    edges = known.unionByName(written(verified(written(pruned(pairs, bitmap, threshold), "pairs")), "links"))
    if not hot.take(1):
        return components(edges)
    hubs = hot.groupBy("key").agg(F.min("node").alias("hub"))
    star = hot.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    edges = edges.unionByName(written(verified(written(pruned(star, bitmap, threshold), "pairs")), "links"))
    labels = components(edges)
    placed = hot.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    placed = written(placed, "hot")
    shares = placed.groupBy("key", "label").agg(F.count("*").alias("rows"))
    main = shares.groupBy("key").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.sum("rows").alias("all"), (F.sum("rows") - F.max("rows")).alias("few")).where("few > 0")
    blocks = main.select("key", "main", F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.ceil(F.col("few") / block).cast("int").alias("few_blocks"))
    rows = placed.join(blocks, "key").join(bitmap, "node")
    columns = ("key", "one", "two", "outer", "node", "label", "n", "bits")
    apart = rows.where("label <> main").withColumn("one", F.pmod(F.xxhash64("node"), "few_blocks").cast("int"))
    apart = apart.withColumn("two", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("outer", F.lit(True)).select(*columns)
    every = rows.withColumn("two", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    every = every.withColumn("one", F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1))).withColumn("outer", F.lit(False)).select(*columns)

    def meet(table: pa.Table) -> pa.Table:
        node, label, n, outer = (table.column(c).to_numpy() for c in ("node", "label", "n", "outer"))
        bits = bit_rows(table.column("bits"))
        inner = np.flatnonzero(~outer)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(outer):
            j = inner[label[inner] != label[i]]
            j = j[within_ring(bits[[i]], bits[j], n[j] + n[i], threshold)] if len(j) else j
            out_a.append(np.minimum(node[j], node[i]))
            out_b.append(np.maximum(node[j], node[i]))
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    between = apart.unionByName(every).groupBy("key", "one", "two").applyInArrow(meet, "a bigint, b bigint").distinct()
    return components(edges.unionByName(written(verified(written(between, "pairs")), "links")))


def _hot_pairs(hot: DataFrame, bitmap: DataFrame, threshold: float, cross: bool, block: int) -> DataFrame:
    blocks = hot.groupBy("key").agg(F.count("*").alias("rows")).select("key", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    placed = hot.join(blocks, "key").join(bitmap, "node").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.withColumn("other", other).select(
        "key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "node", "side", "n", "bits"
    )

    def meet(table: pa.Table) -> pa.Table:
        node, side, mine, n = (table.column(c).to_numpy() for c in ("node", "side", "mine", "n"))
        bits = bit_rows(table.column("bits"))
        same = table.column("one")[0].as_py() == table.column("two")[0].as_py()
        out_a, out_b = [], []
        for i in range(len(node)):
            if not same and mine[i] != table.column("one")[0].as_py():
                continue
            j = np.arange(i + 1, len(node)) if same else np.flatnonzero(mine != mine[i])
            j = j[(node[j] != node[i]) & ((side[j] != side[i]) if cross else True)]
            if len(j):
                j = j[within_ring(bits[[i]], bits[j], n[j] + n[i], threshold)]
                swap = (side[j] < side[i]) if cross else (node[j] < node[i])
                out_a.append(np.where(swap, node[j], node[i]))
                out_b.append(np.where(swap, node[i], node[j]))
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate(out_a or [empty]), "b": np.concatenate(out_b or [empty])})

    return spread.groupBy("key", "one", "two").applyInArrow(meet, "a bigint, b bigint")


def few_rows(rows: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The rows, marked to be sent to all tasks where they are counted to be at most ``most``; beyond, an ordinary join takes its course."""
    return F.broadcast(rows) if rows.count() <= most else rows


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's connected component.

    Edges are (a, b). Each round takes the smallest label among neighbours and then the label's own label, so
    the number of rounds grows with the logarithm of the longest path. Labels are written after each round, so
    lineage stays short. Nothing is collected but the number of changed labels.
    """
    both = written(edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b")).where("a <> b").distinct(), "edges")
    last = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    labels = last
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        better = labels.join(near.hint("merge"), "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("lower"))
        own = labels.select(F.col("node").alias("lower"), F.col("label").alias("further"))
        step = better.join(own.hint("merge"), "lower", "left").select("node", F.least("lower", F.coalesce("further", "lower")).alias("next"), "label")
        done = written(step, "labels")
        changed = done.where("next <> label").limit(1).count()
        labels = done.select("node", F.col("next").alias("label"))
        dropped(last)
        last = done
        if not changed:
            dropped(both)
            return labels
    raise RuntimeError(f"components not found in {rounds} rounds")
