import math
import random

import pytest
from pyspark.sql import functions as F

from oakloom.operators import metrics, registry


def test_pages_break_ties_by_id(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 5) for i in range(1, 31)], "id bigint, status string, created_at int")
    assert [r.id for r in registry.page(df, number=2, size=4, status="a").collect()] == [21, 19, 17, 15]
    assert registry.page_total(df, status="a").first().total == 15 and registry.page_total(df).first().total == 30
    for wrong in ({"number": 0}, {"size": 0}, {"size": 101}):
        with pytest.raises(ValueError):
            registry.page(df, **wrong)


def test_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id bigint, name string")
    assert registry.lookup(df, "id", 1).name == "a"
    with pytest.raises(LookupError):
        registry.lookup(df, "id", 9)
    with pytest.raises(ValueError):
        registry.lookup(df, "id", 2)


def test_parents(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id bigint")
    children = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "id bigint, experiment_id bigint")
    assert [r.id for r in registry.with_parent(children, parents, "experiment_id").collect()] == [10]
    assert sorted(r.id for r in registry.without_parent(children, parents, "experiment_id").collect()) == [11, 12]
    assert [tuple(r) for r in registry.children_of(parents, children, "experiment_id").collect()] == [(1, 10)]


def test_latest_keeps_explicit_null(spark):
    log = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "x", 5), (2, "y", 4)], "id bigint, status string, seq bigint")
    assert {tuple(r) for r in registry.latest(log, "id", "status", ["seq"]).collect()} == {(1, None), (2, "x")}


def test_metrics_merge(spark):
    base = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (2, None), (3, "broken"), (4, '{"c": null}')], "id bigint, m string")
    entries = registry.json_entries(base, "id", "m").withColumnRenamed("name", "key")
    patches = spark.createDataFrame([(1, "b", None, 5), (1, "c", 4.0, 6), (2, "z", 1.0, 1), (2, "z", 3.0, 2)], "id bigint, key string, value double, seq bigint")
    got = {tuple(r) for r in registry.merged_metrics(entries, patches).collect()}
    assert got == {(1, "a", 1.0), (1, "b", None), (1, "c", 4.0), (2, "z", 3.0), (4, "c", None)}


def test_versions(spark):
    rows = [("m", "9", "Staging"), ("m", "10", "Production"), ("n", "x", None), ("n", "3", None), ("o", None, None)]
    df = spark.createDataFrame(rows, "name string, version string, stage string")
    assert {tuple(r) for r in registry.latest_version(df).collect()} == {("m", "10"), ("n", None), ("o", None)}
    assert registry.resolved_version(df, "m") == "10" and registry.resolved_version(df, "m", stage="Staging") == "9" and registry.resolved_version(df, "m", "7") == "7"
    for name in ("n", "o", "absent"):
        with pytest.raises(LookupError):
            registry.resolved_version(df, name)


def test_validation(spark):
    rows = [("ok", None, "running"), ("", "d", "created"), ("x" * 256, "d" * 1001, "odd"), (None, "d", None)]
    df = spark.createDataFrame(rows, "name string, description string, status string")
    assert [r[0] for r in df.select(registry.violations(registry.experiment_rules())).collect()] == [[], ["name"], ["name", "description", "status"], ["name", "status"]]
    asks = spark.createDataFrame([("t", 10, 0.0, 1.0), ("", 0, 2.1, -0.1)], "text string, max_length int, temperature double, top_p double")
    assert [r[0] for r in asks.select(registry.violations(registry.request_rules())).collect()] == [[], ["text", "max_length", "temperature", "top_p"]]
    for rows, status in (([(True,), (True,)], "ok"), ([(True,), (None,)], "degraded"), ([], "ok")):
        assert registry.readiness(spark.createDataFrame(rows, "ok boolean")).first().status == status


def test_late_and_repeated_rows_collapse(spark):
    rows = [("r", "k", 1.0, 10, 1), ("r", "k", 2.0, 10, 3), ("r", "k", 9.0, 10, 2), ("r", "k", 5.0, None, 4), ("r", "k", 6.0, None, 5), (None, "k", 1.0, 1, 6)]
    got = metrics.delivered_once(spark.createDataFrame(rows, "run string, key string, value double, step bigint, seq bigint")).collect()
    assert {(r.run, r.step, r.value) for r in got} == {("r", 10, 2.0), ("r", None, 5.0), ("r", None, 6.0), (None, 1, 1.0)}


def test_eval_loss_is_the_mean_of_batch_means(spark):
    df = spark.createDataFrame([(1, 1.0)] * 4 + [(2, 3.0), (3, None)], "batch_id bigint, loss double")
    got = metrics.eval_loss(df).first()
    assert got.eval_loss == 2.0 and math.isclose(got.perplexity, math.exp(2))
    assert metrics.eval_loss(df.limit(0)).first().eval_loss == 0.0


def test_running_best(spark):
    rows = [("r", s, s, v) for s, v in enumerate([3.0, 2.0, 2.0, 1.0, float("nan"), None, float("inf"), 0.5])]
    df = spark.createDataFrame(rows, "run string, step bigint, seq bigint, value double")
    assert [r.improved for r in metrics.running_best(df).orderBy("step").collect()] == [True, True, False, True, False, False, False, True]
    draw = random.Random(1)
    rows = [(draw.choice("ab"), draw.choice([None, *range(300)]), k, draw.choice([draw.random(), None])) for k in range(600)]
    df = spark.createDataFrame(rows, "run string, step bigint, seq bigint, value double")
    got = {(r.run, r.seq): r.improved for r in metrics.running_best(df, buckets=7).collect()}
    best: dict = {}
    for run, step, seq, value in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        better = value is not None and value < best.get(run, math.inf)
        assert got[run, seq] == better
        if better:
            best[run] = value
    assert metrics.running_best(df.limit(0)).count() == 0


def test_schedule_and_steps(spark):
    got = {r.step: r.factor for r in metrics.schedule(spark, 100, 10).collect()}
    assert got[0] == 0.0 and got[5] == 0.5 and got[10] == 1.0 and math.isclose(got[55], 0.55, abs_tol=1e-9)
    assert tuple(spark.range(1).select(*metrics.total_steps(F.lit(7), 3, 0.1)).first()) == (21, 2)


def test_epochs_groups_and_counts(spark):
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 3.0), ("r", 3, None), ("r", 4, 5.0), ("r", None, 9.0)], "run string, step bigint, value double")
    assert {tuple(r) for r in metrics.epoch_means(df, 2).collect()} == {("r", 0, 2.0, 2), ("r", 1, 5.0, 2)}
    names = spark.createDataFrame([("blocks.0.norm1.weight", 4, True), ("a.bias", 2, True), ("a.weight", 8, False)], "name string, numel bigint, requires_grad boolean")
    assert [r[0] for r in names.select(metrics.weight_decay("name")).collect()] == [0.0, 0.0, 0.01]
    assert tuple(metrics.parameter_counts(names).first()) == (14, 6)
    maps = spark.createDataFrame([("r", {"a": 1.0, "b": 2.0}, 5), ("r", None, 6)], "run string, m map<string,double>, step bigint")
    assert {tuple(r) for r in metrics.as_log_rows(maps, "run", "m", "step").collect()} == {("r", "a", 1.0, 5), ("r", "b", 2.0, 5)}
