import random

import pytest
from pyspark.sql import functions as F

from oakloom.functions import text as X
from oakloom.functions import tokens as T
from oakloom.operators import corpus, windows


def one(spark, value, *columns, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(*columns).first()


@pytest.mark.parametrize("text", ["a\r\nb\r", "a\x1cb", "\n", "", "a b\x85c\x0b\x0cd", "\r\n\r\n", "no end", "x\n\ny\n", "\x1d\x1e"])
def test_lines_are_those_of_splitlines(spark, text):
    assert one(spark, text, X.lines("x"))[0] == text.splitlines()


def test_lines_of_null(spark):
    assert one(spark, None, X.lines("x"))[0] is None


def test_strip_and_words_follow_unicode(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    rows = [(s + "ab" + s + "c" + s,) for s in spaces] + [("",), (None,), (" ",), ("a  b　c",)]
    for text, stripped, count in spark.createDataFrame(rows, "x string").select("x", X.strip("x"), X.word_count("x")).collect():
        assert stripped == (text.strip() if text is not None else None) and count == len((text or "").split())


def test_cleaning_band_is_closed_and_after_strip(spark):
    rows = [("　 hello wor \t",), ("123456789",), ("12345678",), (None,), ("1234567890",)]
    df = spark.createDataFrame(rows, "line string")
    assert [r.line for r in corpus.clean_lines(df, least=9, most=9).collect()] == ["hello wor", "123456789"]
    assert tuple(corpus.clean_stats(df, [], least=9, most=10).first()) == (5, 3, 28)


def test_template_echo_and_prefix(spark):
    df = spark.createDataFrame([("a%b", "r", "x" * 60)], "p string, r string, t string")
    got = df.select(X.full_text("p", "r", "<e>"), X.echo_answer("t"), X.without_prefix(F.concat("p", F.lit("  out \n")), "p")).first()
    assert got[0] == "### Instruction:\na%b\n\n### Response:\nr<e>" and got[1] == f"[Model output for: {'x' * 50}...]" and got[2] == "out"


def test_human_number(spark):
    rows = [(4_125_000,), (999,), (4_500_000_000,), (1000,), (0,), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "n bigint").select(X.human_number("n")).collect()] == ["4.12M", "999", "4.50B", "1.00K", "0", None]


def test_tokens(spark):
    df = spark.createDataFrame([("aé日🙂",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(T.code_points("x")).collect()] == [[97, 233, 0x65E5, 0x1F642], [], []]
    assert [r[0] for r in df.select(T.code_points("x", 2)).collect()] == [[97, 233], [], []]
    assert [r[0] for r in df.select(T.detokenise((233,))(T.code_points("x"))).collect()] == ["a日🙂", "", ""]
    assert one(spark, "abc", T.keep_last(T.code_points("x"), 2))[0] == [98, 99] and one(spark, "abc", T.keep_last(T.code_points("x"), 9))[0] == [97, 98, 99]
    got = [r[0] for r in df.select(T.byte_pairs(T.vocabulary_path(), 3, end=50_256)("x")).collect()]
    assert len(got[0]) == 3 and got[1:] == [[50_256], [50_256]]
    assert one(spark, "a", T.out_of_range(T.code_points("x"), 97), T.out_of_range(T.code_points("x"), 98)) == (True, False)


def packed(spark, docs, length, stride, **options):
    df = spark.createDataFrame(list(enumerate(docs)), "k bigint, t array<int>")
    return {r.k: r.window for r in windows.pack_windows(df, "k", "t", length, stride, **options).collect()}


def test_packing_golden_cases(spark):
    assert packed(spark, [list(range(10))], 4, 4) == {0: [0, 1, 2, 3, 4], 1: [4, 5, 6, 7, 8]}
    assert packed(spark, [[0, 1, 2, 3, 4]], 4, None) == {0: [0, 1, 2, 3, 4]}
    assert packed(spark, [[0, 1, 2], [], None, [3, 4, 5, 6]], 4, 2) == {0: [0, 1, 2, 3, 4], 1: [2, 3, 4, 5, 6]}
    with pytest.raises(ValueError):
        packed(spark, [[0, 1, 2, 3]], 4, 4)
    assert packed(spark, [[0, 1, 2, 3]], 4, 4, strict=False) == packed(spark, [], 4, 4, strict=False) == {}


@pytest.mark.parametrize("length, stride", [(3, 1), (5, 5), (4, 9), (7, 2), (1, 1)])
def test_packing_equals_the_plain_loop(spark, length, stride):
    draw = random.Random(length * stride)
    docs = [[draw.randrange(100) for _ in range(draw.choice([0, 1, 2, 5, 17]))] for _ in range(40)]
    flat = [t for d in docs for t in d]
    expected = {k: flat[i : i + length + 1] for k, i in enumerate(range(0, len(flat) - length, stride))}
    assert packed(spark, docs, length, stride) == expected
    df = spark.createDataFrame(list(enumerate(docs)), "k bigint, t array<int>")
    for r in df.select("t", windows.document_windows("t", length, stride).alias("w")).collect():
        assert r.w == [r.t[i : i + length + 1] for i in range(0, len(r.t) - length, stride)]


def test_labels(spark):
    df = spark.createDataFrame([([0, 1, 2, 3, 4],)], "w array<int>")
    assert tuple(df.select(*windows.next_token_pair("w")).first()) == ([0, 1, 2, 3], [1, 2, 3, 4])
    full = spark.createDataFrame([([5, 6, 7, 8, 9], 2), ([5, 6], 9), ([], 0)], "f array<int>, p int")
    ids, labels = windows.masked_labels("f", F.col("p"), 4)
    got = full.select(ids.alias("i"), labels.alias("l")).select("i", "l", windows.trains_nothing("l")).collect()
    assert [tuple(r) for r in got] == [([5, 6, 7, 8], [-100, -100, 7, 8], False), ([5, 6], [-100, -100], True), ([], [], True)]


def test_batches_are_numbered_and_padded(spark):
    rows = [(i, [1] * n, [1] * n) for i, n in [(5, 3), (-7, 1), (9, 2), (10**15, 4), (11, 0)]]
    df = spark.createDataFrame(rows, "id bigint, input_ids array<int>, labels array<int>")
    got = {r.id: (r.batch_id, r.row, r.input_ids, r.labels) for r in windows.padded(windows.numbered_batches(df, "id", 2)).collect()}
    assert got[-7] == (0, 0, [1, 0, 0], [1, -100, -100]) and got[5] == (0, 1, [1] * 3, [1] * 3)
    assert got[9] == (1, 0, [1, 1], [1, 1]) and got[11] == (1, 1, [0, 0], [-100, -100]) and got[10**15] == (2, 0, [1] * 4, [1] * 4)
    assert windows.numbered_batches(df.limit(0), "id", 2).count() == 0


def test_shuffle_is_repeatable_and_complete(spark):
    df = spark.range(100).withColumn("at", windows.seeded("id", 7))
    a, b = ({(r.id, r.batch_id, r.row) for r in windows.numbered_batches(x, "at", 8, ("id",)).collect()} for x in (df, df.repartition(7)))
    assert a == b and {(k, r) for _, k, r in a} == {(i // 8, i % 8) for i in range(100)}
