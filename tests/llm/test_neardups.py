import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import dressed, edited, plain_words, sentence, similarity
from oakloom.llm.nearsets import bitmaps, candidate_pairs, components, within_ring
from oakloom.llm.neardups import near_duplicates, pairs_in_groups

SAMPLES = "sample_id bigint, prompt string, response string"


def records(seed, n=90):
    draw = random.Random(seed)
    base = [(sentence(draw, 10), " ".join(sentence(draw) for _ in range(draw.randint(2, 5)))) for _ in range(n)]
    rows = [(k, p, r) for k, (p, r) in enumerate(base)]
    for k in range(n, 3 * n):
        p, r = draw.choice(base)
        rows.append((k, p, dressed(draw, r)) if draw.random() < 0.3 else (k, p, edited(draw, r, draw.randint(1, 12))))
    return rows + [(9000, None, None), (9001, "", "!"), (9002, "only prompt here", None), (9003, None, "only prompt here")]


def brute(rows, threshold=0.7):
    words = {i: plain_words((p or "") + " " + (r or "")) for i, p, r in rows}
    group = {i: i for i in words}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(words)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if words[i] and words[j] and similarity(words[i], words[j]) >= threshold:
                group[find(j)] = find(i)
    return {frozenset(j for j in ids if find(j) == k) for k in {find(i) for i in ids}}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_equal_brute_force(spark, seed):
    rows = records(seed)
    expected = {g for g in brute(rows) if len(g) > 1}
    groups = {}
    for r in near_duplicates(spark.createDataFrame(rows, SAMPLES)).collect():
        groups.setdefault(r.group_id, set()).add(r.sample_id)
    assert {frozenset(g) for g in groups.values()} == expected
    key = {i: (plain_words(p), plain_words(r)) for i, p, r in rows}
    pairs = {(r.sample_id_a, r.sample_id_b) for r in pairs_in_groups(near_duplicates(spark.createDataFrame(rows, SAMPLES))).collect()}
    assert pairs == {(i, j) for g in expected for i in g for j in g if i < j and key[i] != key[j]}


def test_ring_filter_loses_nothing():
    draw = random.Random(7)
    for threshold in (0.6, 0.75, 0.9):
        sets = []
        for _ in range(300):
            a = {draw.getrandbits(62) for _ in range(draw.randint(1, 200))}
            b = {x for x in a if draw.random() < 0.97} | {draw.getrandbits(62) for _ in range(draw.randint(0, 20))} or a
            sets += [a, b]
        flat = np.array([x for s in sets for x in s], np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        bits = bitmaps(flat, owner, len(sets))
        sizes = np.array([len(a) + len(b) for a, b in zip(sets[::2], sets[1::2])])
        alive = within_ring(bits[::2], bits[1::2], sizes, threshold)
        assert all(k or similarity(a, b) < threshold for k, a, b in zip(alive, sets[::2], sets[1::2]))


def test_hot_keys_give_the_same_pairs(spark):
    draw = random.Random(8)
    rows = [(draw.randrange(5), draw.getrandbits(40), draw.randrange(2)) for _ in range(400)]
    keys = spark.createDataFrame(rows, "key bigint, node bigint, side int")
    bitmap = keys.select("node").distinct().selectExpr("node", "100L as n", "cast(repeat('x', 128) as binary) as bits")
    for cross in (False, True):
        plain = {tuple(r) for r in candidate_pairs(keys, bitmap, 0.7, cross, most=1000).collect()}
        hot = {tuple(r) for r in candidate_pairs(keys, bitmap, 0.7, cross, most=10, block=16).collect()}
        expected = {((min(a, b), max(a, b)) if not cross else (a, b) if s < t else (b, a)) for k, a, s in rows for j, b, t in rows if k == j and a != b and (not cross or s != t)}
        assert plain == hot == expected


@pytest.mark.parametrize("seed", [1, 4])
def test_large_keys_are_resolved_by_hubs(spark, seed):
    rows = records(seed, 50)
    expected = {g for g in brute(rows) if len(g) > 1}
    groups = {}
    for r in near_duplicates(spark.createDataFrame(rows, SAMPLES), most=2).collect():
        groups.setdefault(r.group_id, set()).add(r.sample_id)
    assert {frozenset(g) for g in groups.values()} == expected


def test_a_third_of_the_records_are_variants_of_one(spark):
    """Not copies but edited texts, every one with words of its own."""
    draw = random.Random(11)
    text = " ".join(sentence(draw) for _ in range(5))
    rows = [(k, "p", f"{text} {draw.choice('abc')}{k} x{k}") if k % 3 == 0 else (k, sentence(draw), sentence(draw)) for k in range(4500)]
    groups = near_duplicates(spark.createDataFrame(rows, SAMPLES))
    assert [r["count"] for r in groups.groupBy("group_id").count().collect()] == [1500]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1002, 1001)], "a bigint, b bigint")
    labels = {r.node: r.label for r in components(edges).collect()}
    assert all(labels[i] == 1 for i in range(1, 301)) and labels[1002] == labels[1001] == 1000
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_third_of_the_records_are_copies(spark):
    draw = random.Random(9)
    text = " ".join(sentence(draw) for _ in range(3))
    rows = [(k, "p", dressed(draw, text)) if k % 3 == 0 else (k, sentence(draw), sentence(draw)) for k in range(1500)]
    rows.append((2000, "p", edited(draw, text, 3)))
    groups = near_duplicates(spark.createDataFrame(rows, SAMPLES))
    assert sorted(r["count"] for r in groups.groupBy("group_id").count().collect()) == [501]
    assert pairs_in_groups(groups).count() == 500


def test_empty_table_long_text_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], SAMPLES)).count() == 0
    draw = random.Random(10)
    long = " ".join(sentence(draw) for _ in range(4000))
    rows = [(1, "q", long), (2, "q", long + " and more"), (2, "q", long + " and more"), (3, "zzz", "unlike anything")]
    df = spark.createDataFrame(rows, SAMPLES).withColumns({c: F.lit("x") for c in ("node", "words", "key", "a", "b", "n", "label", "group_id")})
    got = near_duplicates(df).collect()
    assert sorted(r.sample_id for r in got) == [1, 2, 2] and len({r.group_id for r in got}) == 1
