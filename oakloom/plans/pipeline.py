"""The chain from raw files to an evaluation: clean, pack, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakloom.functions.tokens import code_points
from oakloom.operators import metrics, model, windows
from oakloom.operators.corpus import clean_lines, clean_stats
from oakloom.sources.files import text_files, text_lines
from oakloom.sources.sinks import write_text


def preprocess(spark: SparkSession, source: str, target: str, held_out: tuple[str, ...] = (), least: int = 10, most: int = 10_000) -> DataFrame:
    """Writes the clean lines of the source's files, those named in ``held_out`` left out, in order of path and line; returns (lines_in, lines_out, chars_out)."""
    lines = text_lines(spark, source)
    if held_out:
        lines = lines.where(~F.element_at(F.split("path", "/"), -1).isin(*held_out))
    write_text(clean_lines(lines, least=least, most=most), target, ["path", "line_no"])
    return clean_stats(lines, [], least=least, most=most)


def training_windows(spark: SparkSession, source: str, length: int, stride: int | None = None, vocabulary: int | None = None) -> DataFrame:
    """(k, input_ids, labels) of all files of a folder by path; tokens are code points, taken modulo the vocabulary's size where it is given.

    Paths alone are sorted, by ranges; their place, which grows with the path but has gaps, orders the texts.
    """
    files = text_files(spark, source)
    places = files.select("path").repartitionByRange("path").sortWithinPartitions("path").withColumn("place", F.monotonically_increasing_id())
    packed = windows.pack_texts(files.join(places, "path"), "place", "text", length, stride)
    tokens = packed.select("k", code_points("window").alias("tokens"))
    if vocabulary:
        tokens = tokens.withColumn("tokens", F.transform("tokens", lambda t: F.pmod(t, F.lit(vocabulary))))
    ids, labels = windows.next_token_pair("tokens")
    return tokens.select("k", ids.alias("input_ids"), labels.alias("labels"))


def evaluate(samples: DataFrame, weights: dict, config: model.ModelConfig, batch_size: int = 8) -> DataFrame:
    """(eval_loss, perplexity) of a model over windows, batches in the order of k."""
    losses = model.sequence_losses(samples, "k", weights, config)
    return metrics.eval_loss(losses.withColumn("batch_id", F.expr(f"k div {batch_size}")))
