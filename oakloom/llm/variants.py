"""Problem 2: records that are the same but for spacing, case, punctuation and key order.

Progressive partition refinement. One reading of the texts gives each record 32 bytes: its id, a cheap invariant (the numbers of letters and
digits of prompt and response and their histograms) and 128 bits of its words in order. Classes of the invariant come first; only
those with several members are refined by the words. The words' hash is taken in the same reading, as reading the suspects' texts again, or moving them, would cost more
than it does; nothing but these rows is shuffled.
"""

from __future__ import annotations

import json

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oakloom.llm.storage import written
from oakloom.llm.words import map_batches, sequence_key, words

_COLUMNS = ("sample_id", "prompt", "response", "line", "is_raw")


def _refuse(token: str) -> None:
    raise ValueError(token)


def parse_record(line: str | None) -> tuple[str | None, str | None] | None:
    """Prompt and response of a raw line, or None where it isn't a record.

    A record is strictly valid JSON (no NaN or Infinity, no bare control characters), an object, and has
    both keys. Of a key given twice the last value holds. A value that isn't a string counts as its JSON text, null as null.
    """
    if line is None:
        return None
    try:
        found = json.loads(line, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict) or "prompt" not in found or "response" not in found:
        return None
    return tuple(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in (found["prompt"], found["response"]))


def all_records(samples: DataFrame, raw: DataFrame | None) -> DataFrame:
    """Parsed and unparsed records in one table of id, prompt, response, line and is_raw."""
    one = samples.select("sample_id", "prompt", "response", F.lit(None).cast("string").alias("line"), F.lit(False).alias("is_raw"))
    if raw is None:
        return one
    none = F.lit(None).cast("string")
    return one.unionByName(raw.where("line is not null").select("sample_id", none.alias("prompt"), none.alias("response"), "line", F.lit(True).alias("is_raw")))


def _pairs(batch):
    for i, p, r, line, is_raw in zip(*(batch.column(c).to_pylist() for c in _COLUMNS)):
        if is_raw:
            found = parse_record(line)
            if found is None:
                continue
            p, r = found
        yield i, p, r


def _histogram(stripped: str) -> bytes:
    codes = np.frombuffer(stripped.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes & 63, minlength=64).astype(np.uint32).tobytes()


def _keys(batch):
    ids, cheap, a, b = [], [], [], []
    for i, p, r in _pairs(batch):
        p, r = words(p), words(r)
        raw = b""
        for text in (p, r):
            stripped = "".join(text)
            raw += len(stripped).to_bytes(8, "little") + _histogram(stripped)
        x, y = sequence_key(p, r)
        ids.append(i)
        cheap.append(int.from_bytes(xxhash.xxh64_digest(raw), "little", signed=True))
        a.append(x)
        b.append(y)
    return {"sample_id": ids, "cheap": cheap, "key_a": a, "key_b": b}


def _keyed(samples: DataFrame, raw: DataFrame | None) -> DataFrame:
    return written(map_batches(all_records(samples, raw), _keys, "sample_id bigint, cheap bigint, key_a bigint, key_b bigint"), "keys")


def _refined(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alone, suspects): the ids of records whose invariant no other has, and the rows of the others."""
    cheap = keyed.groupBy("cheap").agg(F.count("*").alias("members"), F.min("sample_id").alias("sample_id"))
    several = cheap.where("members > 1").select("cheap")
    return cheap.where("members = 1").select("sample_id"), keyed.join(several.hint("merge"), "cheap", "left_semi")


def _classes(suspects: DataFrame) -> DataFrame:
    return suspects.groupBy("cheap", "key_a", "key_b").agg(F.min("sample_id").alias("first_id"), F.count("*").alias("copies"))


def format_variants(samples: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """(sample_id, first_id, copies): each record that has copies, with the smallest id and the size of its class.

    Records are copies when prompts and responses have the same words in the same order. Records whose
    class has one member get no row; see ``collapsed`` for one row per class. Null and wordless prompts and
    responses are alike and are compared as such. Lines that aren't records give no row. Further columns are ignored.
    The classes are counted with partial aggregates before any shuffle; a class that holds a large share of
    all rows is joined back to its first id by an ordinary join, which AQE splits.
    """
    _, suspects = _refined(_keyed(samples, raw))
    classes = _classes(suspects).where("copies > 1")
    return suspects.join(classes.hint("merge"), ["cheap", "key_a", "key_b"]).select("sample_id", "first_id", "copies")


def collapsed(samples: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """(sample_id, copies): one row per class of format variants, under its smallest id, with its number of copies."""
    alone, suspects = _refined(_keyed(samples, raw))
    return alone.select("sample_id", F.lit(1).cast("bigint").alias("copies")).unionByName(_classes(suspects).select(F.col("first_id").alias("sample_id"), "copies"))
