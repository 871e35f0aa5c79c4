"""The reading of a text as words, shared by the operators of this folder.

Words: Unicode NFKC, format characters (category Cf) dropped, lower case; then the maximal runs of
letters and digits. NFKC has no JVM built-in, so this runs inside Arrow batches. Pure ASCII texts, to
which neither step applies, skip them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

_RUN = re.compile(r"[^\W_]+")
BATCH_BYTES = 4_000_000
_FORMAT = regex.compile(r"\p{Cf}+")


def fold(text: str | None) -> str:
    """NFKC, without format characters, in lower case; null gives an empty text."""
    if text is None:
        return ""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words of a text in order; null, blank and mark-only texts have none."""
    return _RUN.findall(fold(text))


class WordIds(dict):
    """word -> 64-bit id, stable over processes; filled while it is read.

    It forgets everything once it holds ``most`` words, so that a worker's memory stays bounded.
    """

    most = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        value = value - (1 << 64) if value >= 1 << 63 else value
        self[word] = value
        return value


def id_array(found: list[str], ids: WordIds) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, found), np.int64, len(found))


def sequence_key(*texts: list[str]) -> tuple[int, int]:
    """128 bits of the words of several texts, in order."""
    raw = "\x1e".join("\x1f".join(t) for t in texts).encode("utf-8", "surrogatepass")
    a = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(a[:8], "little", signed=True), int.from_bytes(a[8:], "little", signed=True)


def map_batches(df: DataFrame, work: Callable, schema: str, per_task: bool = False) -> DataFrame:
    """``mapInArrow`` for a function from a batch to columns; ``schema`` is a DDL string.

    Batches of more than ``BATCH_BYTES`` are cut, so that a task's memory follows the longest text and not the rows of a batch.

    With ``per_task``, ``work`` is called without arguments at the start of each task and returns that function.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work() if per_task else work
        for whole in batches:
            step = max(1, whole.num_rows * BATCH_BYTES // max(whole.nbytes, BATCH_BYTES))
            for at in range(0, whole.num_rows, step):
                out = function(whole.slice(at, step))
                columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, out[f.name]) for f in arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def list_array(flat: np.ndarray, sizes: np.ndarray | list[int], kind: pa.DataType) -> pa.Array:
    """A list column from its values in one array and the size of each list."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def list_parts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in one array and the row of each."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)
