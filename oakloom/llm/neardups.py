"""Problem 3: records of mostly the same words, in groups.

1. Each record becomes the set of its distinct words. Records with equal sets form a node; copies cost nothing further.
2. The words of a node stand on a ring of segments. Nodes with an equal segment meet, and of these those whose chain of
   following segments keeps to the pigeonring's budgets are candidates (rings.py).
3. The full Hamming check over sketches of all words, as wide as the sets are large, prunes them where they meet (rings.py).
4. What remains is compared word by word; linked nodes are joined into groups. Keys of large families of similar records are resolved by
   hubs, so that a family isn't paired up within itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oakloom.llm.nearsets import bit_column, bitmaps, components, few_rows, linked_components
from oakloom.llm.rings import DEALT_BY, DEALT_SIZE, LARGE, dealt_words, ring_candidates, ring_suffixes
from oakloom.llm.storage import dropped, written
from oakloom.llm.suffixes import often
from oakloom.llm.words import WordIds, id_array, list_array, list_parts, map_batches, sequence_key, words


def _tokenised(samples: DataFrame) -> DataFrame:
    """(sample_id, key_a, key_b, node, words): words only at the first record of a node in each task, else null."""

    def start():
        ids, seen = WordIds(), set()

        def work(batch):
            key_a, key_b, node, sizes, flats, valid = [], [], [], [], [], []
            for p, r in zip(batch.column("prompt").to_pylist(), batch.column("response").to_pylist()):
                p, r = words(p), words(r)
                a, b = sequence_key(p, r)
                own = np.unique(id_array(p + r, ids))
                one = int.from_bytes(xxhash.xxh3_64_digest(own.tobytes()), "little", signed=True)
                key_a.append(a)
                key_b.append(b)
                node.append(one if len(own) else None)
                fresh = len(own) > 0 and one not in seen
                if fresh:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(one)
                    flats.append(own)
                sizes.append(len(own) if fresh else 0)
                valid.append(fresh)
            lists = list_array(np.concatenate(flats) if flats else np.zeros(0, np.int64), sizes, pa.int64())
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array([not v for v in valid]))
            return {"sample_id": batch.column("sample_id"), "key_a": key_a, "key_b": key_b, "node": node, "words": lists}

        return work

    return map_batches(samples.select("sample_id", "prompt", "response"), start, "sample_id bigint, key_a bigint, key_b bigint, node bigint, words array<bigint>", per_task=True)


def _dealt(lists: DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """The segments of frequent words, from about ``DEALT_BY`` of the nodes; which these are makes keys rarer or more frequent, not results."""
    one_in = max(1, lists.count() // DEALT_BY)
    some = lists.where((F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0) & (F.size("words") <= DEALT_SIZE)).limit(2 * DEALT_BY).select("words").toArrow()
    words = some.column("words").combine_chunks()
    return dealt_words(words.flatten().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), threshold) if len(words) else None


def _key_times(lists: DataFrame, dealt: tuple[np.ndarray, np.ndarray] | None, threshold: float) -> DataFrame:
    """(key, times) of frequent ring keys of every eighth node; key 0 stands for all."""
    sent = lists.sparkSession.sparkContext.broadcast(dealt)

    def work(batch):
        flat, owner = list_parts(batch, "words")
        n = np.bincount(owner, minlength=batch.num_rows)
        some = np.arange(batch.num_rows) % 8 == 0
        prefix = ring_suffixes(flat[some[owner]], n[some], threshold, sent.value)[1]
        key, times = often(prefix, 0.001, 8)
        return {"key": np.append(key, np.uint64(0)).view(np.int64), "times": np.append(times, len(prefix)).astype(np.int64)}

    return map_batches(lists, work, "key bigint, times bigint")


def _bitmaps(lists: DataFrame) -> DataFrame:
    """(node, n, bits): the size and bitmap of each node."""

    def work(batch):
        flat, owner = list_parts(batch, "words")
        return {"node": batch.column("node"), "n": np.bincount(owner, minlength=batch.num_rows), "bits": bit_column(bitmaps(flat, owner, batch.num_rows))}

    return map_batches(lists, work, "node bigint, n bigint, bits binary").groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))


def linked_nodes(lists: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose word sets have at least the similarity."""
    need = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "need")
    sets = lists.join(few_rows(need), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))
    sets = written(sets, "sets")
    both = pairs.join(sets.selectExpr("node as a", "words as wa").hint("merge"), "a").join(sets.selectExpr("node as b", "words as wb").hint("merge"), "b")

    def compare(batch):
        parts = [(batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("wa", "wb")]
        keep = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            one, two = (v[o[k] : o[k + 1]] for v, o in parts)
            every = np.sort(np.concatenate([one, two]))
            shared = int((every[1:] == every[:-1]).sum())  # each is a set
            keep[k] = shared >= threshold * (len(every) - shared) - 1e-9
        return {c: batch.column(c).to_numpy()[keep] for c in ("a", "b")}

    return map_batches(both, compare, "a bigint, b bigint")


def near_duplicates(samples: DataFrame, threshold: float = 0.7, most: int = 512) -> DataFrame:
    """(sample_id, group_id, key_a, key_b): each record linked to another, its group and its key as a format variant.

    Records are linked when the sets of their words have at least the similarity ``threshold``; groups are
    taken transitively, under a stable id. Records with equal word sets are linked; records without words to none.
    Null prompts and responses count as empty. Repeated rows are records of their own. Further columns are ignored.
    Two records of similarity 0.8 or more have a segment in common from which the chain keeps to its budgets, and nearly all down to the
    threshold have (rings.py). They meet there, however many records hold that segment: runs of equal keys are compared by their chains and sketches, and those
    that hold a large family, or more records than one task's, are resolved by hubs and in blocks. Every link found is exact; recall against brute force is in the README.
    ``most`` bounds the rows of a key that are paired at once there.
    """
    tokens = written(_tokenised(samples), "tokens", dictionary=4 << 20)
    lists = tokens.where("words is not null").select("node", "words")
    dealt = _dealt(lists, threshold)
    times = written(_key_times(lists, dealt, threshold), "times").groupBy("key").agg(F.sum("times").alias("times"))
    seen = times.where("key = 0").first()
    sampled = seen.times if seen else 0
    hot = times.where((F.col("key") != 0) & (F.col("times") > max(LARGE / 8, 0.002 * sampled))).select("key")  # at most 500, as each stands for 0.2 % of the keys
    hot = np.sort(np.array([r.key for r in hot.collect()], np.int64).view(np.uint64))
    found = written(ring_candidates(lists, hot, 8 * sampled, threshold, dealt), "found")
    pairs = written(found.where("b is not null").select("a", "b").distinct(), "pairs")
    edges = written(linked_nodes(lists, pairs, threshold), "links")
    keys = found.where("b is null").select("key", F.col("a").alias("node"), F.lit(0).alias("side"))
    if keys.take(1):
        bitmap = written(_bitmaps(lists.join(few_rows(written(keys.select("node").distinct(), "hubs")), "node", "left_semi")), "sizes")
        labels = linked_components(keys, bitmap, threshold, lambda some: linked_nodes(lists, some, threshold), edges, most)
    else:
        labels = components(edges)
    members = tokens.where("node is not null").select("sample_id", "node", "key_a", "key_b").join(labels.hint("merge"), "node", "left")
    members = written(members.select("sample_id", F.coalesce("label", "node").alias("group_id"), "key_a", "key_b"), "members")
    several = members.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1").select("group_id")
    dropped(found, pairs)
    return members.join(several.hint("merge"), "group_id", "left_semi").select("sample_id", "group_id", "key_a", "key_b")


def representative_pairs(groups: DataFrame) -> DataFrame:
    """(group_id, sample_id_a, sample_id_b, copies): each class of format variants but the first of its group, by its smallest id, with the
    smallest id of the group's first class; copies is the number of records of the class of sample_id_b.

    With the groups themselves this says all that the pairs within them do, in rows that don't grow with the square of a group.
    """
    classes = groups.groupBy("group_id", "key_a", "key_b").agg(F.min("sample_id").alias("sample_id_b"), F.count("*").alias("copies"))
    first = classes.groupBy("group_id").agg(F.min("sample_id_b").alias("sample_id_a"))
    return classes.join(first.hint("merge"), "group_id").where("sample_id_a <> sample_id_b").select("group_id", "sample_id_a", "sample_id_b", "copies")


def pairs_in_groups(groups: DataFrame, chunk: int = 5000) -> DataFrame:
    """(sample_id_a, sample_id_b): every two records of a group that aren't format variants; the smaller id first.

    Only groups with at least two variants are joined. The result itself is as large as the pairs asked for, so this is for checks;
    ``representative_pairs`` grows with the records. A group of more than ``chunk`` records is cut into that many times smaller parts, each of which meets the whole group in a task of its own.
    """
    known = groups.groupBy("group_id").agg(F.min(F.struct("key_a", "key_b")).alias("lo"), F.max(F.struct("key_a", "key_b")).alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    parts = known.select("group_id", F.ceil(F.col("size") / chunk).cast("int").alias("parts"))
    members = groups.join(parts.hint("merge"), "group_id")
    a = members.select("group_id", F.pmod(F.xxhash64("sample_id"), "parts").cast("int").alias("part"), F.col("sample_id").alias("sample_id_a"), F.col("key_a").alias("a1"), F.col("key_b").alias("a2"))
    b = members.select("group_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("sample_id").alias("sample_id_b"), F.col("key_a").alias("b1"), F.col("key_b").alias("b2"))
    return a.join(b.hint("merge"), ["group_id", "part"]).where("sample_id_a < sample_id_b and (a1 <> b1 or a2 <> b2)").select("sample_id_a", "sample_id_b")
