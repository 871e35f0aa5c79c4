"""Problem 4: responses over their limit, cut into overlapping pieces at natural boundaries.

Every gap between two code points has a strength. A sparse table over (strength, position) answers the
strongest cut of any window in constant time and breaks ties rightward; the next piece starts ``overlap``
code points before the cut.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oakloom.llm.words import map_batches

#: Strengths of a gap, by what stands before it; a gap within a line end of two, or between a letter and its mark, is the last resort.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, NONE, WITHIN = 5, 4, 3, 2, 1, 0, -1
# Marks that end a sentence or a clause; those of the second list need no space after them.
SENTENCE_MARKS, WIDE_SENTENCE_MARKS = ".!?…", "。！？"
CLAUSE_MARKS, WIDE_CLAUSE_MARKS = ",;:", "，；：、"
CLOSERS = "\"'”’)»]*_"


@functools.cache
def _joined() -> np.ndarray:
    """Of each code point whether it belongs to the one before: combining marks, selectors, the zero-width joiner."""
    out = np.zeros(0x110000, bool)
    for lo, hi in ((0x300, 0x3100), (0xA600, 0xAC00), (0xFB00, 0x1E000), (0x1E000, 0x1F000)):
        out[lo:hi] = [unicodedata.category(chr(c))[0] == "M" for c in range(lo, hi)]
    out[0x200D] = out[0x1F3FB:0x1F400] = out[0xE0100:0xE01F0] = True
    return out


def boundary_strengths(text: str) -> np.ndarray:
    """strengths[i]: how natural a cut after the first i code points is, for i from 0 to the length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(codes) + 1, np.int64)
    if not len(codes):
        return out
    space = np.isin(codes, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    newline = codes == 10
    last = np.append(0, codes[:-1])
    # the mark before closing quotes and brackets
    mark = last
    for _ in range(2):
        mark = np.where(np.isin(mark, [ord(x) for x in CLOSERS]), np.append(0, mark[:-1]), mark)

    def of(marks: str, source: np.ndarray) -> np.ndarray:
        return np.isin(source, [ord(x) for x in marks])

    after = out[1:]
    after[space] = SPACE
    after[of(WIDE_CLAUSE_MARKS, codes) | (space & of(CLAUSE_MARKS, mark))] = CLAUSE
    after[of(WIDE_SENTENCE_MARKS, codes) | (space & of(SENTENCE_MARKS, mark))] = SENTENCE
    after[newline] = LINE
    after[newline & ((last == 10) | (last == 13) & (np.append([0, 0], codes[:-2])[: len(codes)] == 10))] = PARAGRAPH
    out[:-1][(newline & (last == 13)) | _joined()[codes]] = WITHIN
    out[1:-1][codes[:-1] == 0x200D] = WITHIN
    out[0] = NONE
    return out


class StrongestCut:
    """Sparse table of maxima over (strength, position)."""

    def __init__(self, strengths: np.ndarray):
        n = len(strengths)
        self.levels = [strengths.astype(np.int64) * n + np.arange(n)]
        self.n, width = n, 1
        while 2 * width <= n:
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: n - 2 * width + 1], last[width : n - width + 1]))
            width *= 2

    def best(self, lo: int, hi: int) -> int:
        """The strongest position of lo..hi, both included; the rightmost of equals."""
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - (1 << k) + 1])) % self.n


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces; each holds at most ``limit`` code points.

    A cut lies in the second half of what the limit permits, and always beyond the overlap, so every piece
    brings new text. A text within the limit is one piece, an empty one too.
    """
    n = len(text)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n)]
    # strengths and table cover a stretch of many pieces at a time, so that memory doesn't grow with the text
    stretch = max(32 * limit, 1 << 16)
    out, start, base, table = [], 0, 0, None
    while n - start > limit:
        if table is None or start + limit >= base + table.n:
            base, before = start, max(0, start - 4)
            # four code points before and one after show what stands around the stretch's ends
            table = StrongestCut(boundary_strengths(text[before : base + stretch + 1])[base - before : base - before + stretch + 1])
        cut = base + table.best(start - base + max(overlap + 1, (limit + 1) // 2), start - base + limit)
        out.append((start, cut))
        start = cut - overlap
    out.append((start, n))
    return out


def limits_by_path(configs: DataFrame) -> DataFrame:
    """(path, max_length, overlap) of every path of the data configs; of a path in several configs, the smallest limit."""
    path = F.explode(F.array_distinct(F.array("train_path", "val_path", "test_path"))).alias("path")
    one = configs.where("max_length > 0").select(path, "max_length", (F.col("max_length") - F.coalesce("stride", "max_length")).alias("overlap"))
    return one.where("path is not null").groupBy("path").agg(F.min(F.struct("max_length", "overlap")).alias("m")).select("path", "m.max_length", "m.overlap")


def split_responses(samples: DataFrame, configs: DataFrame, with_text: bool = True) -> DataFrame:
    """(sample_id, piece_no, start, end[, text]): the pieces of every response over its limit.

    Size is the number of code points; one code point counts as one token. Responses within the limit, null
    responses and records whose path no config names get no row. Only oversized responses reach Python. A
    stride over max_length counts as max_length, one under 1 as 1. Repeated rows are cut alike.
    """
    limits = limits_by_path(configs.select("train_path", "val_path", "test_path", "max_length", "stride"))
    over = samples.select("sample_id", "path", "response").join(limits, "path").where(F.length("response") > F.col("max_length"))

    def work(batch):
        out = {"sample_id": [], "piece_no": [], "start": [], "end": [], "text": []}
        for i, text, limit, overlap in zip(*(batch.column(c).to_pylist() for c in ("sample_id", "response", "max_length", "overlap"))):
            for k, (start, end) in enumerate(pieces(text, limit, overlap)):
                out["sample_id"].append(i)
                out["piece_no"].append(k)
                out["start"].append(start)
                out["end"].append(end)
                out["text"].append(text[start:end] if with_text else None)
        return out

    schema = "sample_id bigint, piece_no int, start int, end int" + ", text string" * with_text
    return map_batches(over.select("sample_id", "response", "max_length", "overlap"), work, schema)
