import numpy as np
import pytest
from pyspark.sql import functions as F

from oakloom.functions import numerics as N
from oakloom.operators import model, sampling


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(1)
    return spark.createDataFrame([(i, draw.normal(size=8).tolist(), int(draw.integers(8))) for i in range(30)], "id bigint, x array<double>, y int").cache()


def test_columns_against_numpy(vectors):
    w = F.array(*(F.lit(float(i)) for i in range(8)))
    got = vectors.select("id", "x", "y", N.rms_norm("x", w).alias("r"), N.softmax("x", 0.5).alias("s"), N.cross_entropy("x", "y").alias("c"), N.cross_entropy("x", F.lit(-100)).alias("none"),
                         N.apply_rope("x", F.col("id").cast("double"), 8).alias("p"), N.dot("x", "x").alias("d"), N.norm_scale("x", 1.0).alias("n")).collect()
    cos, sin = (np.array(t) for t in N.rope_tables(8, 30))
    for r in got:
        x = np.array(r.x)
        assert np.allclose(r.r, np.arange(8) * x / np.sqrt((x * x).mean() + 1e-6))
        e = np.exp(x / 0.5)
        assert np.allclose(r.s, e / e.sum()) and np.isclose(r.c, np.log(np.exp(x).sum()) - x[r.y]) and r.none is None
        assert np.allclose(r.p, x * cos[r.id] + np.concatenate([-x[4:], x[:4]]) * sin[r.id])
        assert np.isclose(r.d, x @ x) and np.isclose(r.n, min(1, 1 / (np.linalg.norm(x) + 1e-6)))
    with pytest.raises(ValueError):
        N.softmax("x", 0)


def test_nucleus(spark):
    logits = spark.createDataFrame([(1, np.log([0.95, 0.03, 0.02]).tolist()), (2, np.log([0.2, 0.5, 0.3]).tolist()), (3, [0.0, 0.0])], "id bigint, x array<double>")
    kept = {k: {r.token for r in sampling.nucleus(logits, "id", "x", 0.9).where(F.col("id") == k).collect()} for k in (1, 2, 3)}
    assert kept == {1: {0}, 2: {1, 2}, 3: {0}}
    assert sampling.nucleus(logits, "id", "x", 1.0).count() == 8
    draws = [sampling.drawn(sampling.nucleus(logits, "id", "x", 0.9), "id", s).orderBy("id").collect() for s in (1, 1)]
    assert draws[0] == draws[1] and draws[0][0].token == 0


def test_draws_follow_the_distribution(spark):
    logits = spark.range(4000).select("id", F.array(*(F.lit(float(np.log(p))) for p in (0.5, 0.3, 0.2))).alias("x"))
    counts = {r.token: r["count"] for r in sampling.drawn(sampling.nucleus(logits, "id", "x", 1.0), "id").groupBy("token").count().collect()}
    assert all(abs(counts[t] / 4000 - p) < 0.03 for t, p in enumerate((0.5, 0.3, 0.2)))


CONFIG = model.ModelConfig(vocab_size=100, n_embed=64, n_layer=2, n_head=4, max_seq_len=32)


def test_parameters():
    assert model.ModelConfig().count() == 36_839_936
    assert model.ModelConfig(n_embed=256, n_layer=4).count() == 5_835_008
    assert sum(w.size for w in model.initial_weights(CONFIG).values()) == CONFIG.count()


def test_forward_is_causal():
    weights, tokens = model.initial_weights(CONFIG), np.arange(16)
    full = model.forward(tokens, weights, CONFIG)
    assert full.shape == (16, 100)
    assert np.allclose(full[:9], model.forward(tokens[:9], weights, CONFIG))
    changed = tokens.copy()
    changed[12] = 99
    assert np.allclose(full[:12], model.forward(changed, weights, CONFIG)[:12]) and not np.allclose(full[12:], model.forward(changed, weights, CONFIG)[12:])


def test_model_over_rows(spark):
    weights = model.initial_weights(CONFIG)
    rows = [(1, [1, 2, 3], [2, 3, -100]), (2, [], []), (3, [4], [5])]
    df = spark.createDataFrame(rows, "id bigint, input_ids array<bigint>, labels array<bigint>")
    losses = {(r.id, r.position): r.loss for r in model.sequence_losses(df, "id", weights, CONFIG).collect()}
    logits = model.forward(np.array([1, 2, 3]), weights, CONFIG)
    assert set(losses) == {(1, 0), (1, 1), (3, 0)} and np.isclose(losses[1, 1], np.log(np.exp(logits[1]).sum()) - logits[1, 3])
    last = {r.id: r.logits for r in model.last_logits(df, "id", "input_ids", weights, CONFIG).collect()}
    assert np.allclose(last[1], logits[-1]) and last[2] is None


def test_generation(spark):
    weights = model.initial_weights(CONFIG)
    df = spark.createDataFrame([(i, [i, 2, 3, 4, 5]) for i in range(1, 6)] + [(9, [])], "id bigint, t array<bigint>")
    for options in ({}, {"temperature": 0.7}, {"temperature": 1.0, "top_p": 1.0}):
        a, b = ({r.id: r.tokens for r in model.generated(x, "id", "t", weights, CONFIG, 10, **options).collect()} for x in (df, df.repartition(3)))
        assert a == b and all(len(a[i]) == 15 and a[i][:5] == [i, 2, 3, 4, 5] for i in range(1, 6)) and a[9] == []
    long = spark.createDataFrame([(1, list(range(60)))], "id bigint, t array<bigint>")
    assert len(model.generated(long, "id", "t", weights, CONFIG, 3).first().tokens) == 63
    greedy = model.generated(df, "id", "t", weights, CONFIG, 10).first().tokens
    assert model.generated(df, "id", "t", weights, CONFIG, 10, end=greedy[5]).first().tokens == greedy[:6]
    with pytest.raises(Exception, match="outside a vocabulary"):
        model.last_logits(spark.createDataFrame([(1, [100])], "id bigint, t array<bigint>"), "id", "t", weights, CONFIG).collect()
