"""Tokenizers: code points as built-in expressions, byte-pair vocabularies as an Arrow function."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Fixed value: the published pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def code_points(text: Column | str, max_length: int | None = None) -> Column:
    """Token array of a text, one code point each; cut to ``max_length`` only where it is given; null and empty texts have none.

    A batch of texts is read as UTF-32 in Arrow; splitting into characters in the JVM makes a string and a boxed number of each.
    """

    @F.arrow_udf(ArrayType(IntegerType()))
    def points(texts: pa.Array) -> pa.Array:
        found = texts.to_pylist()
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(t) for t in found], out=ends[1:])
        flat = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return points(text if max_length is None else F.left(text, F.lit(max_length)))


def keep_last(tokens: Column | str, n: int) -> Column:
    """The last n tokens, the context that a model of that length sees."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), F.lit(n))


def detokenise(special: tuple[int, ...] = ()):
    """Column function: text of code-point tokens without the special ones."""

    @F.pandas_udf("string")
    def decode(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None else "".join(chr(x) for x in t if x not in special))

    return decode


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(os.environ.get("OAKLOOM_TOKENIZERS", "/opt/tokenizers"), name)


def encoder_of(path: str):
    """The encoder of a byte-pair vocabulary file of ranks."""
    import tiktoken

    with open(path, "rb") as rows:
        ranks = {base64.b64decode(a): int(b) for a, b in (row.split() for row in rows)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_pairs(path: str, max_length: int | None = None, end: int | None = None):
    """Column function: tokens of a byte-pair vocabulary file of ranks; ``end`` is appended where given, before the cut."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(path)
        for batch in batches:
            tail = [] if end is None else [end]
            yield batch.map(lambda t: (encoder.encode_ordinary(t) if t else []) + tail).map(lambda t: t if max_length is None else t[:max_length])

    return encode


def out_of_range(tokens: Column | str, size: int) -> Column:
    """Whether any token is not below the vocabulary's size."""
    return F.coalesce(F.array_max(tokens) >= size, F.lit(False))
