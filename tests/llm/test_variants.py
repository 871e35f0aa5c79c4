import json
import random

from pyspark.sql import functions as F

from fixtures import dressed, plain_words, sentence
from oakloom.llm.variants import collapsed, format_variants, parse_record

SAMPLES, RAW = "sample_id bigint, prompt string, response string", "sample_id bigint, line string"


def tables(seed=1):
    draw = random.Random(seed)
    base = [(sentence(draw, 8), sentence(draw, 12)) for _ in range(60)]
    samples = [(k, dressed(draw, p), dressed(draw, r)) for k in range(200) for p, r in [draw.choice(base)]]
    samples += [(900, None, None), (901, "", " -- "), (902, None, "x"), (903, "x", None), (904, "a b", "c"), (905, "a", "b c")]
    raw = []
    for k in range(1000, 1060):
        p, r = draw.choice(base)
        keys = {"prompt": dressed(draw, p), "response": dressed(draw, r), "n": 1}
        raw.append((k, json.dumps(dict(sorted(keys.items(), reverse=draw.random() < 0.5)))))
    raw += [(1100, ""), (1101, None), (1102, '{"prompt": "a"}'), (1103, '{"prompt": "a b", "response": "c",}'), (1104, '["prompt", "response"]'), (1105, '{"prompt": null, "response": NaN}'),
            (1106, '{"prompt": "a b", "response": "\\u0063"}'), (1107, '{"prompt": null, "response": null}')]
    return samples, raw


def brute(samples, raw):
    seen = {}
    for i, p, r in samples:
        seen.setdefault((tuple(plain_words(p)), tuple(plain_words(r))), []).append(i)
    for i, line in raw:
        if (found := parse_record(line)) is not None:
            seen.setdefault(tuple(tuple(plain_words(t)) for t in found), []).append(i)
    return seen


def test_equals_brute_force(spark):
    samples, raw = tables()
    expected = brute(samples, raw)
    got = {(r.sample_id, r.first_id, r.copies) for r in format_variants(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(raw, RAW)).collect()}
    assert got == {(i, min(v), len(v)) for v in expected.values() if len(v) > 1 for i in v}
    rows = {(r.sample_id, r.copies) for r in collapsed(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(raw, RAW)).collect()}
    assert rows == {(min(v), len(v)) for v in expected.values()}


def test_records_of_raw_lines():
    assert parse_record('{"response": "b", "prompt": "a", "x": [1]}') == ("a", "b")
    assert parse_record('{"prompt": 5, "response": null}') == ("5", None)
    for broken in (None, "", "[]", "5", '{"prompt": "a"}', "{'prompt': 'a', 'response': 'b'}", '{"prompt": "a", "response": "b"} x', '{"prompt": "a\tb", "response": "c"}', '{"prompt": 1, "response": Infinity}', "[" * 100_000):
        assert parse_record(broken) is None


def test_empty_tables_repeats_and_clashing_columns(spark):
    assert format_variants(spark.createDataFrame([], SAMPLES), spark.createDataFrame([], RAW)).count() == 0
    rows = [(1, "a " * 60_000, "b"), (1, "a " * 60_000, "b"), (2, "A " * 60_000, "B!")]
    df = spark.createDataFrame(rows, SAMPLES).withColumns({c: F.lit(0) for c in ("cheap", "key_a", "key_b", "first_id", "n", "line", "is_raw")})
    assert sorted((r.sample_id, r.first_id, r.copies) for r in format_variants(df).distinct().collect()) == [(1, 1, 3), (2, 1, 3)]
    assert [tuple(r) for r in collapsed(df).collect()] == [(1, 3)]


def test_a_third_of_the_rows_are_one_class(spark):
    draw = random.Random(2)
    rows = [(k, "Same words here", dressed(draw, "and there")) if k % 3 == 0 else (k, f"p {k}", f"r {k}") for k in range(3000)]
    got = format_variants(spark.createDataFrame(rows, SAMPLES)).groupBy("first_id", "copies").count().collect()
    assert [tuple(r) for r in got] == [(0, 1000, 1000)]
