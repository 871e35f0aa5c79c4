"""Selection of tokens from distributions: nucleus, draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oakloom.functions.numerics import softmax
from oakloom.operators.windows import hashed_number


def nucleus(logits: DataFrame, key: str, column: str, top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """(key, token, rank, p): the tokens kept by nucleus selection, with their probabilities renormalised.

    Tokens go by falling probability, ties by the smaller token; those beyond a cumulated ``top_p`` are
    dropped, the first never. A top_p of 1 or more keeps all. A distribution is sorted and summed up where it stands, in Arrow batches; only what is kept becomes rows.
    """

    def kept(batches):
        for batch in batches:
            names, parts = [], []
            for name, p in zip(batch[key], batch["_p"]):
                if p is None or not len(p):
                    continue
                order = np.argsort(-np.asarray(p), kind="stable")
                p = np.asarray(p)[order]
                last = len(p) if top_p >= 1 else max(1, int(np.searchsorted(np.cumsum(p), top_p, side="right")))
                names += [name] * last
                parts.append((order[:last], np.arange(1, last + 1), p[:last] / p[:last].sum()))
            token, rank, share = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
            yield pd.DataFrame({key: names, "token": token, "rank": rank, "p": share})

    kind = logits.schema[key].dataType.simpleString()
    return logits.select(key, softmax(column, temperature).alias("_p")).mapInPandas(kept, f"`{key}` {kind}, token int, rank int, p double")


def drawn(kept: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(key, token): one token of each distribution by the inverse of its sums at a number hashed from key and seed."""
    u = (hashed_number(key, seed, 13) / float(2**52)).alias("_u")
    sums = F.sum("p").over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("rank").over(Window.partitionBy(key))
    reached = kept.select(key, "token", "rank", u, sums.alias("_sum"), last.alias("_last")).where((F.col("_sum") > F.col("_u")) | (F.col("rank") == F.col("_last")))
    return reached.groupBy(key).agg(F.min_by("token", "rank").alias("token"))
