import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import dressed, plain_words, sentence
from oakloom.llm.leaks import PassageSearch, leaked_items

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, passage string"


def brute(docs, items, run=12):
    def grams(text):
        w = plain_words(text)
        return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}

    read = [(j, grams(p)) for j, p in items]
    return {(i, j) for i, t in docs for g in [grams(t)] for j, h in read if g & h}


def tables(seed=1):
    draw = random.Random(seed)
    items = [(k, " ".join(sentence(draw) for _ in range(draw.randint(1, 4)))) for k in range(40)] + [(100, None), (101, ""), (102, "too short to match")]
    items += [(103, items[0][1])]
    docs = []
    for k in range(150):
        parts = [sentence(draw) for _ in range(draw.randint(0, 8))]
        if draw.random() < 0.5:
            w = plain_words(draw.choice(items[:40])[1])
            n = draw.choice([10, 11, 12, 13, 20, 60])
            at = draw.randrange(max(1, len(w) - n + 1))
            parts.insert(draw.randrange(len(parts) + 1), dressed(draw, " ".join(w[at : at + n])))
        docs.append((k, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "​")], items


def test_equals_brute_force_in_any_number_of_blocks(spark):
    docs, items = tables()
    expected = brute(docs, items)
    assert len(expected) > 20
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for size in (10**9, 900):
        assert {tuple(r) for r in leaked_items(d, i, block_chars=size).collect()} == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40), st.integers(3, 14))
def test_search_finds_every_shared_run(text, passage, run):
    shared = {tuple(text[i : i + run]) for i in range(len(text) - run + 1)} & {tuple(passage[i : i + run]) for i in range(len(passage) - run + 1)}
    assert PassageSearch([(7, passage)], run).find(text) == ({7} if shared else set())


def test_empty_tables_long_texts_repeats_and_clashing_columns(spark):
    docs, items = tables(2)
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaked_items(none_d, spark.createDataFrame(items, ITEMS)).count() == leaked_items(spark.createDataFrame(docs, DOCS), none_i).count() == 0
    long = "filler words " * 200_000 + items[3][1]
    d = spark.createDataFrame([(1, long), (1, long)], DOCS).withColumns({c: F.lit(1) for c in ("item_id", "passage", "lang")})
    got = [tuple(r) for r in leaked_items(d, spark.createDataFrame(items, ITEMS).withColumn("text", F.lit("x"))).collect()]
    assert got == [(1, 3), (1, 3)]


def test_blocks_keep_their_bound():
    from oakloom.llm.leaks import _within

    sizes = [5, 90, 30, 30, 41, 200, 1, 99, 100]
    blocks = list(_within(((k, "x" * n) for k, n in enumerate(sizes)), 100))
    assert [k for b in blocks for k, _ in b] == list(range(len(sizes))) and all(sum(len(t) for _, t in b) <= 100 or len(b) == 1 for b in blocks)
    assert list(_within(iter([]), 100)) == [[]]
