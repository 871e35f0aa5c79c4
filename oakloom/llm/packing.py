"""Problem 6: documents packed into sequences of fixed capacity.

Sizes are tokens of a public tokenizer. A document over the capacity fills whole sequences and leaves a
remainder; nothing else is split. The pieces are packed in blocks of bounded size, each by one task: best fit
decreasing first, then a local search on the underfull bins that moves a document, or exchanges one or two of
them for a smaller one of a fuller bin, as long as the sum of squared fills grows; bins that run empty
are closed. The bins of a block that stay underfull are opened again and packed in a second round of few, larger blocks.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oakloom.functions.tokens import encoder_of, vocabulary_path
from oakloom.llm.storage import written
from oakloom.llm.words import map_batches

BLOCK_BITS = 32


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, tokens): the number of tokens of each text; nought for null and empty ones."""

    def start():
        encoder = encoder_of(vocabulary)

        def work(batch):
            texts = batch.column("text").to_pylist()
            return {"doc_id": batch.column("doc_id"), "tokens": [len(encoder.encode_ordinary(t)) if t else 0 for t in texts]}

        return work

    return map_batches(documents.select("doc_id", "text"), start, "doc_id bigint, tokens bigint", per_task=True)


class Bins:
    """Bins of one capacity; holds sizes by bin and improves them."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity, self.size = capacity, sizes
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        rooms: dict[int, list[int]] = {}
        order: list[int] = []  # the rooms for which some bin is open, ascending
        for item in np.argsort(-sizes, kind="stable").tolist():
            need = int(sizes[item])
            at = bisect.bisect_left(order, need)
            if at < len(order):
                room = order[at]
                k = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, k = capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[k].append(item)
            self.fill[k] += need
            left = room - need
            if left:
                if left not in rooms:
                    rooms[left] = []
                    bisect.insort(order, left)
                rooms[left].append(k)

    def improve(self) -> None:
        """Empties underfull bins, the emptiest first, into the others, until no exchange raises the squared fill or no fewer bins can hold the sizes.

        The squared fill grows by each exchange, so this ends.
        """
        self.ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.spare = len(self.bins) - -(-int(self.size.sum()) // self.capacity)
        moved = True
        while moved and self.spare > 0:
            open_bins = sorted((k for k in range(len(self.bins)) if 0 < self.fill[k] < self.capacity), key=lambda k: self.fill[k])
            moved = False
            for u in open_bins:
                moved |= self._drain(u, open_bins)
                if self.spare <= 0:
                    return

    def _sorted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, sizes) of a bin by size."""
        if k not in self.ordered:
            items = np.array(self.bins[k])
            items = items[np.argsort(self.size[items], kind="stable")]
            self.ordered[k] = items, self.size[items]
        return self.ordered[k]

    def _drain(self, u: int, open_bins: list[int]) -> bool:
        """Exchanges with the fuller bins, the largest gain first, as long as there is one."""
        moved = False
        while self.bins[u]:
            fuller = [v for v in open_bins if v != u and self.bins[v] and self.fill[u] <= self.fill[v] < self.capacity]
            found = self._exchange(u, fuller) if fuller else None
            if found is None:
                return moved
            v, out, back = found
            for i in out:
                self.bins[u].remove(i)
                self.bins[v].append(i)
            for i in back:
                self.bins[v].remove(i)
                self.bins[u].append(i)
            gain = int(self.size[list(out)].sum()) - sum(int(self.size[i]) for i in back)
            self.fill[v] += gain
            self.fill[u] -= gain
            self.ordered.pop(u, None)
            self.ordered.pop(v, None)
            moved = True
        self.spare -= 1
        return moved

    def _exchange(self, u: int, bins: list[int]) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """(v, what to take from u, what to give back): one or two for none or one; of all bins the largest gain that fits v's room."""
        mine, size = self._sorted(u)
        given = [self._sorted(v)[1] for v in bins]
        counts = np.array([len(x) + 1 for x in given])
        ends = np.cumsum(counts)
        back = np.zeros(int(ends[-1]), np.int64)
        filled = np.ones(len(back), bool)
        filled[ends - counts] = False
        back[filled] = np.concatenate(given)
        room = np.repeat(self.capacity - np.array([self.fill[v] for v in bins]), counts)
        most = room + back  # of what is taken, for each that is given back
        one = np.searchsorted(size, most, side="right") - 1
        gain = np.where(one >= 0, size[one] - back, 0)
        at = int(gain.argmax())
        best, taken = int(gain[at]), (int(mine[one[at]]),)
        if len(mine) > 1 and best < room.max():
            # of two, the second is the largest before the first that still fits
            first = np.arange(1, len(mine))
            second = np.minimum(np.searchsorted(size, most[:, None] - size[None, 1:], side="right") - 1, first - 1)
            gain = np.where(second >= 0, size[None, 1:] + size[second] - back[:, None], 0)
            g, f = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[g, f] > best:
                best, at, taken = int(gain[g, f]), int(g), (int(mine[f + 1]), int(mine[second[g, f]]))
        if best <= 0:
            return None
        k = int(np.searchsorted(ends, at, side="right"))
        inside = at - int(ends[k] - counts[k])
        return bins[k], taken, (int(self._sorted(bins[k])[0][inside - 1]),) if inside else ()


def pack(sizes: np.ndarray, capacity: int, search: bool = True) -> np.ndarray:
    """The bin of each size, numbered from 0 without gaps. Without ``search``, best fit decreasing alone."""
    bins = Bins(sizes, capacity)
    if search:
        bins.improve()
    out = np.zeros(len(sizes), np.int64)
    for number, members in enumerate(b for b in bins.bins if b):
        out[members] = number
    return out


def _packed_blocks(pieces: DataFrame, capacity: int, search: bool) -> DataFrame:
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that AQE doesn't gather these few bytes in one task

    def one(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("piece_no").to_numpy(), table.column("doc_id").to_numpy()))
        table = table.take(pa.array(order))
        bins = pack(table.column("tokens").to_numpy(), capacity, search)
        fill = np.bincount(bins, weights=table.column("tokens").to_numpy(), minlength=1).astype(np.int64)
        sequence = table.column("block").to_numpy() << BLOCK_BITS | bins
        return pa.table({"doc_id": table.column("doc_id"), "piece_no": table.column("piece_no"), "first_token": table.column("first_token"), "tokens": table.column("tokens"), "sequence_id": sequence, "fill": fill[bins]})

    schema = "doc_id bigint, piece_no bigint, first_token bigint, tokens bigint, sequence_id bigint, fill bigint"
    return pieces.select("block", "doc_id", "piece_no", "first_token", "tokens").repartition(parts, "block").groupBy("block").applyInArrow(one, schema)


def pack_documents(documents: DataFrame, capacity: int, vocabulary: str | None = None, block_items: int = 4000, good: float = 0.98) -> DataFrame:
    """(doc_id, piece_no, first_token, tokens, sequence_id): the sequence of each document or piece of one.

    No sequence holds more than ``capacity`` tokens. Only documents over the capacity are split: into pieces
    of exactly the capacity, each a sequence of its own, and the rest. Null and empty texts need no room and give no row.
    Repeated rows are packed as documents of their own; further columns are ignored; ties go by doc_id. Blocks
    hold about ``block_items`` pieces at any number of documents; sequences filled under ``good`` go to the second round.
    """
    return pack_counts(counted(documents, vocabulary), capacity, block_items, good)


def counted(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens), written, of the texts that need room; to be packed at several capacities."""
    return written(token_counts(documents, vocabulary or vocabulary_path()).where("tokens > 0"), "tokens")


def pack_counts(counts: DataFrame, capacity: int, block_items: int = 4000, good: float = 0.98, search: bool = True) -> DataFrame:
    """As ``pack_documents``, from written sizes (doc_id, tokens)."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    whole = counts.where(F.col("tokens") >= capacity)
    cut = whole.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("tokens") / capacity) - 1)).alias("piece_no"))
    # full pieces take a block number of their own range, so that their ids meet no other
    full = cut.select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("tokens"))
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    rest = counts.select("doc_id", F.floor(F.col("tokens") / capacity).alias("piece_no"), (F.col("tokens") % capacity).alias("left")).where("left > 0")
    items = rest.count()
    rest = rest.select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.col("left").alias("tokens"))
    blocks = max(1, round(items / block_items))
    # the row's number in the written table spreads rows of one id
    own = F.monotonically_increasing_id()
    first = written(_packed_blocks(rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "tokens", own), F.lit(blocks))), capacity, search), "bins")
    filled = first.where(F.col("fill") >= good * capacity)
    again = first.where(F.col("fill") < good * capacity)
    left = again.count()
    # at most a few bins of each block are underfull unless large documents prevail; those gain nothing from larger blocks
    more = max(1, round(left / (2 * block_items)))
    second = _packed_blocks(again.withColumn("block", blocks + F.pmod(F.xxhash64("doc_id", "tokens", own), F.lit(more))), capacity, search)
    columns = ("doc_id", "piece_no", "first_token", "tokens", "sequence_id")
    return full.select(*columns).unionByName(filled.select(*columns)).unionByName(second.select(*columns))


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(sequences, tokens, least_sequences, used): how full the sequences are; least_sequences is the bound tokens/capacity."""
    each = packed.groupBy("sequence_id").agg(F.sum("tokens").alias("fill"))
    total = F.coalesce(F.sum("fill"), F.lit(0))
    return each.agg(F.count("*").alias("sequences"), total.alias("tokens"), F.ceil(total / capacity).alias("least_sequences"), F.try_divide(total, F.count("*") * capacity).alias("used"))
