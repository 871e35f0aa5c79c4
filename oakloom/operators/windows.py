"""Training samples from token arrays: packed windows, shifted and masked labels, padded batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def _range_of(key: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key; null for a null key."""
    if not bounds:
        return F.when(F.col(key).isNotNull(), 0)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        found = np.searchsorted(np.array(bounds, np.int64), keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(found, pa.int32(), mask=keys.is_null().to_numpy(zero_copy_only=False))

    return place(F.col(key).cast("bigint"))


def offsets(rows: DataFrame, order: str, size: str, ties: tuple[str, ...] = (), buckets: int = 1024) -> DataFrame:
    """The rows with ``offset``, the sum of the sizes before each in the order of a whole-number key, then ``ties``.

    Keys fall into about ``buckets`` ranges of much the same number of rows, by quantiles; the ranges' sums are summed up in one place, and the rows
    within each range in parallel. So no task sees all rows, unless one key has them all. Null keys come first.
    """
    cuts = rows.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] or []
    placed = rows.withColumn("_range", F.coalesce(_range_of(order, sorted({int(c) for c in cuts})), F.lit(-1)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_range").agg(F.sum(size).alias("_sum"))
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("bigint").alias("_start"))
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_first(order), *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(F.sum(size).over(inside), F.lit(0)).cast("bigint"))
    joined = own.join(F.broadcast(starts), "_range")  # at most ``buckets`` and one rows
    return joined.withColumn("offset", F.col("_start") + F.col("_own")).drop("_range", "_start", "_own")


def _packed(sized: DataFrame, ties: tuple[str, ...], length: int, step: int, strict: bool, cut, join) -> DataFrame:
    """(k, window) of rows (_key, _tokens, _n). ``cut`` takes tokens, first and number; ``join`` an array of such parts in order."""
    total = sized.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    windows = -(-(total - length) // step) if total > length else 0
    if strict and not windows:
        raise ValueError(f"{total} tokens make no window of {length} and one")
    # equal keys go by the ties, then by their tokens; rows equal in all of these may change places
    placed = offsets(sized.withColumn("_tie", F.xxhash64("_tokens")), "_key", "_n", (*ties, "_tie"))
    first = F.greatest(F.lit(0), F.ceil((F.col("offset") - length) / step)).cast("bigint")
    last = F.least(F.lit(windows - 1), F.expr(f"(offset + _n - 1) div {step}")).cast("bigint")
    pieces = placed.withColumn("_first", first).withColumn("_last", last).where("_last >= _first")
    start, final = F.col("offset"), F.col("offset") + F.col("_n") - 1

    def piece(k: Column) -> Column:
        lo, hi = F.greatest(k * step, start), F.least(k * step + length, final)
        return F.struct(k.alias("k"), cut(F.col("_tokens"), (lo - start + 1).cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int")).alias("_part"), (hi >= lo).alias("_some"))

    # cut first and spread then, so that no row carries a whole document for each of its windows
    spread_out = pieces.select("offset", F.explode(F.transform(F.sequence("_first", "_last"), piece)).alias("_piece"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "_part")))
    return spread_out.select("_piece.k", "offset", "_piece._part", "_piece._some").where("_some").groupBy("k").agg(join(F.transform(parts, lambda s: s["_part"])).alias("window"))


def pack_windows(docs: DataFrame, key: str, tokens: str, length: int, stride: int | None = None, strict: bool = True, size: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """(k, window): the token arrays one after the other in the order of ``key``, then ``ties``, cut into windows of length + 1 tokens
    that start every ``stride`` tokens (of None or 0: every ``length``).

    A window may cross documents; the last tokens that fill no window are left out. Null and empty arrays
    take no room; documents of one key follow each other, each whole. ``size`` names a column with the arrays' sizes where it is cheaper than the arrays. With
    ``strict``, a stream too short for any window is an error, as in training.
    """
    count = (F.col(size) if size else F.size(tokens)).cast("bigint")
    sized = docs.where(count > 0).select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens"), count.alias("_n"), *(t for t in ties if t != key))
    return _packed(sized, tuple(t for t in ties if t != key), length, stride or length, strict, F.slice, F.flatten)


def pack_texts(docs: DataFrame, key: str, text: str, length: int, stride: int | None = None, strict: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """(k, window): as ``pack_windows`` for tokens of one code point each; windows are texts, so that characters and not numbers are moved."""
    count = F.length(text).cast("bigint")
    sized = docs.where(count > 0).select(F.col(key).alias("_key"), F.col(text).alias("_tokens"), count.alias("_n"), *(t for t in ties if t != key))
    return _packed(sized, tuple(t for t in ties if t != key), length, stride or length, strict, F.substring, lambda parts: F.array_join(parts, ""))


def document_windows(tokens: Column | str, length: int, stride: int | None = None) -> Column:
    """Array of the windows of one document; empty where it is too short."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    step = stride or length
    starts = F.sequence(F.lit(0), F.size(tokens) - length - 1, F.lit(step))
    cut = F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(length + 1)))
    return F.when(F.size(tokens) > length, cut).otherwise(F.array().cast("array<array<int>>"))


def covering_windows(tokens: Column | str, length: int) -> Column:
    """Array of windows of length + 1 tokens, the last one shorter, each from the last token of the one before: every pair
    of neighbours stands in one of them. Empty below two tokens."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    starts = F.sequence(F.lit(0), F.size(tokens) - 2, F.lit(length))
    cut = F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(length + 1)))
    return F.when(F.size(tokens) > 1, cut).otherwise(F.array().cast("array<array<int>>"))


def next_token_pair(window: Column | str) -> tuple[Column, Column]:
    """(input_ids, labels): a window without its last and without its first token."""
    window = F.col(window) if isinstance(window, str) else window
    return F.slice(window, F.lit(1), F.size(window) - 1), F.slice(window, F.lit(2), F.size(window) - 1)


def masked_labels(full: Column | str, prompt_length: Column | int, max_length: int) -> tuple[Column, Column]:
    """(input_ids, labels): prompt and response cut to ``max_length``; the prompt's labels are ignored and labels aren't shifted."""
    ids = F.slice(F.col(full) if isinstance(full, str) else full, 1, max_length)
    hidden = F.least(F.lit(prompt_length) if isinstance(prompt_length, int) else prompt_length, F.size(ids))
    return ids, F.concat(F.array_repeat(F.lit(IGNORED), hidden), F.slice(ids, hidden + 1, F.size(ids) - hidden))


def trains_nothing(labels: Column | str) -> Column:
    """Whether all labels are ignored, so that the mean loss is undefined."""
    return F.size(F.array_remove(labels, IGNORED)) == 0


def numbered_batches(samples: DataFrame, order: str, size: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``batch_id`` and ``row`` of samples in the order of a whole-number column, then ``ties``; the last batch may be smaller."""
    if size < 1:
        raise ValueError("size must be at least 1")
    placed = offsets(samples.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", ties)
    return placed.withColumn("batch_id", F.expr(f"offset div {size}")).withColumn("row", F.col("offset") % size).drop("offset", "_one")


def items(samples: DataFrame, order: str, indices: list[int], ties: tuple[str, ...] = ()) -> DataFrame:
    """The samples at these places in the order of a whole-number column, then ``ties``, with their ``place`` and the number of ``samples``.

    A negative index counts from the end; one outside the dataset is an error, as in a list.
    """
    count = samples.count()
    wanted = sorted({i + count if i < 0 else i for i in indices})
    if wanted and not 0 <= wanted[0] <= wanted[-1] < count:
        raise IndexError(f"{indices} in a dataset of {count}")
    placed = offsets(samples.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", ties).withColumnRenamed("offset", "place")
    return placed.where(F.col("place").isin(wanted)).drop("_one").withColumn("samples", F.lit(count).cast("bigint"))


def with_width(batches: DataFrame, size: str, width: str = "width") -> DataFrame:
    """The rows with the largest size of their ``batch_id``."""
    return batches.withColumn(width, F.max(size).over(Window.partitionBy("batch_id")))


def padded(batches: DataFrame, ids: str = "input_ids", labels: str = "labels", pad: int = 0, width: str | None = None) -> DataFrame:
    """Ids padded with ``pad`` and labels with the ignored label, on the right, to the longest of each ``batch_id``, or to the ``width`` known."""

    def fill(c: str, value: int) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(value), F.col(width or "_longest") - F.size(c)))

    wide = batches if width else batches.withColumn("_size", F.size(ids)).transform(with_width, "_size", "_longest")
    return wide.withColumn(ids, fill(ids, pad)).withColumn(labels, fill(labels, IGNORED)).drop("_longest", "_size")


def hashed_number(key: Column | str, seed: int, digits: int = 15) -> Column:
    """A number of so many hexadecimal digits of the MD5 hash of key and seed, the same in any engine."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), F.lit(digits)), 16, 10).cast("bigint")


def seeded(key: Column | str, seed: int = 42) -> Column:
    """A number to order by for a repeatable shuffle; ties go by the key."""
    return hashed_number(key, seed)
