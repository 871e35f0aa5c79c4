"""Problem 7: evaluation passages that stand, wholly or in part, in documents.

Wu-Manber multi-pattern search over words. A run of ``run`` shared words always holds one of the
passage's pieces of ``piece`` words that start at every ``step``-th word, where piece + step - 1 = run; so
those pieces are the patterns. Blocks of two words index the shift table; a shift of nought leads to the
bucket of the pattern's last block, where the pieces are compared word by word, and a piece that agrees is
extended to both sides in the passage and the document to measure the shared run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oakloom.llm.words import map_batches, words

BLOCK = 2


class PassageSearch:
    """Wu-Manber tables over the passages' pieces."""

    def __init__(self, passages: list[tuple[int, list[str]]], run: int):
        if run < BLOCK + 1:
            raise ValueError(f"run must be at least {BLOCK + 1} words")
        self.run = run
        self.piece = max(BLOCK + 1 if run > BLOCK + 1 else BLOCK, run * 2 // 3)
        self.step = run - self.piece + 1
        self.far = self.piece - BLOCK + 1
        self.passages = passages
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], list[tuple[tuple[str, ...], int, int]]] = {}
        for k, (_, text) in enumerate(passages):
            if len(text) < run:
                continue
            for start in range(0, len(text) - self.piece + 1, self.step):
                piece = tuple(text[start : start + self.piece])
                for j in range(BLOCK, self.piece + 1):
                    block = (piece[j - 2], piece[j - 1])
                    self.shift[block] = min(self.shift.get(block, self.far), self.piece - j)
                self.bucket.setdefault((piece[-2], piece[-1]), []).append((piece, k, start))

    def find(self, text: list[str]) -> set[int]:
        """Ids of the items whose passage shares at least ``run`` consecutive words with the text."""
        found: set[int] = set()
        n, piece, far = len(text), self.piece, self.far
        if n < self.run:
            return found
        shift, bucket, at = self.shift, self.bucket, piece - 1
        while at < n:
            block = (text[at - 1], text[at])
            ahead = shift.get(block, far)
            if ahead:
                at += ahead
                continue
            window = tuple(text[at - piece + 1 : at + 1])
            for pattern, k, start in bucket.get(block, ()):
                if pattern == window and self.passages[k][0] not in found:
                    passage = self.passages[k][1]
                    left = 0
                    lo = at - piece + 1
                    while left < start and left < lo and passage[start - left - 1] == text[lo - left - 1]:
                        left += 1
                    right = 0
                    while start + piece + right < len(passage) and at + 1 + right < n and passage[start + piece + right] == text[at + 1 + right]:
                        right += 1
                    if left + piece + right >= self.run:
                        found.add(self.passages[k][0])
            at += 1
        return found


def _within(passages: Iterable, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """(item_id, passage) in blocks of at most ``block_chars`` code points; at least one block, an empty one for no passages."""
    part, size = [], 0
    for item, text in passages:
        if part and size + len(text) > block_chars:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    yield part


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12, block_chars: int = 32_000_000) -> DataFrame:
    """(doc_id, item_id): the document and the item's passage share a run of at least ``run`` words.

    The documents are never shuffled. Passages go to the executors in blocks of at most ``block_chars`` code points, each searched in a scan
    of its own; the driver holds one block at a time. A single passage larger than a block makes a block of its own.
    Null, blank and short texts and passages shorter than ``run`` words give no rows; passages that stand
    in several items, or repeated rows, give each pair once per document row. Further columns are ignored.
    """
    spark = documents.sparkSession
    passages = items.where(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "passage")
    source = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    result = None
    for part in _within(passages.toLocalIterator(), block_chars):
        sent = spark.sparkContext.broadcast([(i, words(t)) for i, t in part])

        def start(sent=sent):
            search = PassageSearch(sent.value, run)

            def work(batch):
                docs, found = [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    for item in sorted(search.find(words(text))):
                        docs.append(doc)
                        found.append(item)
                return {"doc_id": docs, "item_id": found}

            return work

        one = map_batches(source, start, "doc_id bigint, item_id bigint", per_task=True)
        result = one if result is None else result.unionByName(one)
    return result
