import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import sentence
from oakloom.llm.splitting import StrongestCut, boundary_strengths, pieces, split_responses

SAMPLES = "sample_id bigint, path string, response string"
CONFIGS = "name string, train_path string, val_path string, test_path string, max_length int, stride int"


def check(text, limit, overlap):
    cut = pieces(text, limit, overlap)
    overlap = max(0, min(overlap, limit - 1))
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b in cut)
    assert all(c == b - overlap and d > b for (_, b), (c, d) in zip(cut, cut[1:]))
    return cut


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n,。é🙂", max_size=200), st.integers(1, 40), st.integers(-5, 50))
def test_pieces_cover_within_limit_with_overlap(text, limit, overlap):
    cut = check(text, limit, overlap)
    assert (len(cut) == 1) == (len(text) <= limit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
def test_table_gives_the_rightmost_strongest(strengths, data):
    import numpy as np

    lo = data.draw(st.integers(0, len(strengths) - 1))
    hi = data.draw(st.integers(lo, len(strengths) - 1))
    best = max(range(lo, hi + 1), key=lambda k: (strengths[k], k))
    assert StrongestCut(np.array(strengths)).best(lo, hi) == best


def test_cuts_at_natural_boundaries():
    text = "One sentence here. And another one, longer than that.\n\nA new paragraph begins now and goes on."
    assert [text[a:b] for a, b in pieces(text, 60, 0)] == [text[:55], text[55:]]
    assert boundary_strengths("a. b, c\nd\n\n").tolist() == [0, 0, 0, 3, 0, 0, 2, 0, 4, 0, 4, 5]
    draw = random.Random(1)
    long = " ".join(sentence(draw) for _ in range(3000))
    assert len(check(long, 512, 128)) > 100 and pieces(long, 512, 128)[1][0] == pieces(long[:4000], 512, 128)[1][0]


def test_limits_come_from_the_config(spark):
    configs = [("a", "t", "v", None, 10, 7), ("b", "u", None, None, 5, None), ("c", "t", None, None, 20, 20), ("d", None, None, None, None, None), ("e", "w", None, None, 0, 0)]
    rows = [(1, "t", "x" * 25), (2, "v", "x" * 10), (3, "u", "é" * 6), (4, "other", "x" * 99), (5, None, "x" * 99), (6, "t", None), (7, "t", ""), (8, "w", "xxx"), (3, "u", "é" * 6)]
    df = spark.createDataFrame(rows, SAMPLES).withColumns({c: F.lit("z") for c in ("max_length", "overlap", "train_path", "name", "text")})
    got = split_responses(df, spark.createDataFrame(configs, CONFIGS)).collect()
    assert sorted((r.sample_id, r.piece_no, r.start, r.end) for r in got) == [(1, 0, 0, 10), (1, 1, 7, 17), (1, 2, 14, 24), (1, 3, 21, 25), (3, 0, 0, 5), (3, 0, 0, 5), (3, 1, 5, 6), (3, 1, 5, 6)]
    assert all(len(r.text) == r.end - r.start for r in got)
    none = spark.createDataFrame([], SAMPLES)
    assert split_responses(none, spark.createDataFrame(configs, CONFIGS)).count() == split_responses(df, spark.createDataFrame([], CONFIGS)).count() == 0


def test_cuts_spare_line_ends_marks_and_closers():
    assert pieces("abcdefgh\r\nxyz", 9, 0)[0] == (0, 8) and pieces("abcdefge\u0301xyz", 8, 0)[0] == (0, 7) and pieces("abcdef\u200d\U0001f525xyz", 7, 0)[0] == (0, 5)
    text = 'He said "no." Then he left, and (as it was late.) slept on and on'
    assert boundary_strengths(text)[14] == boundary_strengths(text)[50] == 3
    assert pieces("\u0301" * 30, 8, 2)[-1][1] == 30


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\r,é\u0301", min_size=1, max_size=90), st.integers(2, 12), st.integers(0, 6))
def test_stretches_cut_as_the_whole(text, limit, overlap):
    from oakloom.llm import splitting

    def plain():
        strengths, n, out, start, over = boundary_strengths(text), len(text), [], 0, max(0, min(overlap, limit - 1))
        while n - start > limit:
            cut = max(range(start + max(over + 1, (limit + 1) // 2), start + limit + 1), key=lambda k: (strengths[k], k))
            out.append((start, cut))
            start = cut - over
        return [*out, (start, n)]

    assert splitting.pieces(text, limit, overlap) == plain()
