"""Training and evaluation metrics as relations over a step-keyed log (run, key, value, step, seq)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def every(step: Column | str, n: int) -> Column:
    """The cadence predicate: whether a step is logged, saved or evaluated."""
    return (F.col(step) if isinstance(step, str) else step) % n == 0


def delivered_once(log: DataFrame) -> DataFrame:
    """(run, key, step, value, seq): of each run, key and step the row that arrived last; rows without a step stay apart by seq.

    Late rows and rows delivered twice collapse, in partial hash aggregates. A null seq counts as the first.
    """
    own = F.when(F.col("step").isNull(), F.col("seq"))
    at = F.coalesce("seq", F.lit(-(2**63)))
    keyed = log.groupBy("run", "key", "step", own.alias("_own")).agg(F.max_by("value", at).alias("value"), F.max("seq").alias("seq"))
    return keyed.drop("_own")


def finite(value: Column | str) -> Column:
    """The value where it is a finite number, else null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def epoch_means(losses: DataFrame, steps_per_epoch: int, by: str = "run") -> DataFrame:
    """(by, epoch, mean_loss, batches): mean loss of each epoch of ``steps_per_epoch`` steps."""
    epoch = F.expr(f"(step - 1) div {steps_per_epoch}").alias("epoch")
    return losses.where("step is not null").groupBy(by, epoch).agg(F.avg(finite("value")).alias("mean_loss"), F.count(F.lit(1)).alias("batches"))


def eval_loss(token_losses: DataFrame, batch: str = "batch_id", loss: str = "loss", by: list[str] | None = None) -> DataFrame:
    """(by, eval_loss, perplexity): the mean of the batches' means, each batch alike; 0 without batches. Null losses are ignored."""
    keys = by or []
    means = token_losses.groupBy(*keys, batch).agg(F.avg(loss).alias("_mean"))
    out = means.groupBy(*keys).agg(F.coalesce(F.avg("_mean"), F.lit(0.0)).alias("eval_loss"))
    return out.withColumn("perplexity", F.exp("eval_loss"))


def running_best(losses: DataFrame, by: str = "run", order: str = "step", ties: tuple[str, ...] = ("seq",), value: str = "value", buckets: int = 256) -> DataFrame:
    """Rows with ``best_before`` and ``improved``: strictly below all before; the first finite one improves. NaN and null never do.

    The order, then the ties; rows without a step come first. The lowest of about ``buckets`` ranges of steps of each run
    are taken first, so that a run with a large share of all rows is spread over as many tasks.
    """
    lo, hi = losses.agg(F.min(order), F.max(order)).first()
    width = 1 if lo is None else max(1, -(-(hi - lo + 1) // buckets))
    placed = losses.withColumn("_range", F.coalesce(F.expr(f"`{order}` div {width}L"), F.lit(-(2**62)))).withColumn("_loss", finite(value))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lowest = placed.groupBy(by, "_range").agg(F.min("_loss").alias("_low"))
    starts = lowest.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), F.min("_low").over(before).alias("_start"))
    inside = Window.partitionBy(by, "_range").orderBy(F.asc_nulls_first(order), *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.min("_loss").over(inside))
    joined = own.join(starts, own[by].eqNullSafe(starts["_by"]) & (own["_range"] == starts["_at"]))
    best = F.coalesce(F.least("_start", "_own"), F.lit(float("inf")))
    out = joined.withColumn("best_before", best).withColumn("improved", F.coalesce(F.col("_loss") < F.col("best_before"), F.lit(False)))
    return out.drop("_range", "_loss", "_own", "_by", "_at", "_start")


def learning_rate_factor(step: Column, warmup: int, total: int, least: float = 0.1) -> Column:
    """Linear warm-up, then a cosine from 1 to ``least``."""
    progress = (step - warmup) / max(1, total - warmup)
    cosine = least + (1 - least) * 0.5 * (1 + F.cos(math.pi * progress))
    return F.when(step < warmup, step / max(1, warmup)).otherwise(cosine)


def schedule(spark: SparkSession, total: int, warmup: int, least: float = 0.1) -> DataFrame:
    """(step, factor) of all steps."""
    return spark.range(total).select(F.col("id").alias("step"), learning_rate_factor(F.col("id"), warmup, total, least).alias("factor"))


def total_steps(batches: Column, epochs: Column | int, warmup_ratio: Column | float) -> tuple[Column, Column]:
    """(total_steps, warmup_steps), the second cut towards nought."""
    total = (batches * epochs).cast("bigint")
    return total, F.floor(total * warmup_ratio).cast("bigint")


def weight_decay(name: Column | str, decay: float = 0.01) -> Column:
    """No decay for biases, norms and embeddings, by the parameter's name."""
    return F.when((F.col(name) if isinstance(name, str) else name).rlike("bias|norm|embed"), 0.0).otherwise(decay)


def parameter_counts(parameters: DataFrame) -> DataFrame:
    """(total, trainable): numbers of parameters of a manifest (name, numel, requires_grad)."""
    return parameters.agg(F.coalesce(F.sum("numel"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("requires_grad"), F.col("numel"))), F.lit(0)).alias("trainable"))


def as_log_rows(maps: DataFrame, run: str, metrics: str, step: str) -> DataFrame:
    """(run, key, value, step): a map column of metrics as log rows."""
    return maps.select(run, F.explode(metrics).alias("key", "value"), step)
