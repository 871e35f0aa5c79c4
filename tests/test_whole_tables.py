"""Queries over whole tables and whole texts, against plain readings of small fixtures."""

import json

import numpy as np

import __spark_entry__
from oakloom.operators import model
from oakloom.plans.catalog import _TINY


def test_escaped_lines_are_parsed(spark, tmp_path):
    said = ['a "b" \\ / c', "Prüfung", "line\nend\ttab\x07", "中文 ​﻿ ", "pair 😀", "\\u0041 as text", ""]
    records = [{"prompt": p, "response": r, "rating": 2} for p in said for r in said]
    lines = [json.dumps(x, ensure_ascii=k % 2 == 0) for k, x in enumerate(records)]
    lines += ['{"prompt": "\\u0061\\/", "response": "\\u4E2D\\ud83d\\ude00"}', '{"pr\\u006fmpt": "a", "response": "b"}']
    broken = ["", '{"prompt": "\\u00fc", "response": "b"', '{"prompt": "\\u00fc"}', '["\\u00fc"]', '{"prompt": null, "response": "\\u00fc"}', '{"prompt": "\\u00zz", "response": "b"}']
    rows = list(enumerate(lines + broken))
    spark.createDataFrame(rows, "sample_id bigint, line string").write.parquet(f"{tmp_path}/sft_raw.parquet")
    found = __spark_entry__.queries()["parsed_jsonl"](spark, str(tmp_path)).collect()
    expected = {k: (x["prompt"], x["response"]) for k, x in enumerate(map(json.loads, lines))}
    assert {r.sample_id: (r.prompt, r.response) for r in found} == expected and len(found) == len(expected)


def test_model_queries_read_whole_passages(spark, tmp_path):
    size = _TINY.max_seq_len
    texts = {k: "".join(chr(33 + (7 * k + i * i) % 90) for i in range(n)) for k, n in enumerate([1, 2, 10, size, size + 1, size + 2, 2 * size + 1, 130, 131, 400])}
    spark.createDataFrame([*texts.items(), (98, ""), (99, None)], "item_id bigint, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    run = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    weights, tokens = model.initial_weights(_TINY), {k: [ord(c) for c in t] for k, t in texts.items()}

    logits, losses = {}, {}
    for k, t in tokens.items():
        for w, at in enumerate(range(0, len(t) - 1, size)):
            ids, labels = np.array(t[at : at + size][: len(t) - 1 - at]), t[at + 1 : at + size + 1]
            out = model.forward(ids, weights, _TINY)
            logits[k, w] = out[-1]
            losses.setdefault(k // 8, []).extend(np.log(np.exp(out).sum(axis=-1)) - out[np.arange(len(ids)), labels])
    assert sum(map(len, losses.values())) == sum(len(t) - 1 for t in tokens.values())
    loss, = run("model_eval_loss")
    assert np.isclose(loss.eval_loss, np.mean([np.mean(x) for x in losses.values()])) and np.isclose(loss.perplexity, np.exp(loss.eval_loss))
    found = {(r.item_id, r.k): r.logits for r in run("forward_logits")}
    assert found.keys() == logits.keys() and all(np.allclose(found[x], logits[x]) for x in logits)
    made = {r.item_id: list(r.tokens) for r in run("greedy_generate")}
    assert made.keys() == tokens.keys() and all(made[k][:-8] == t for k, t in tokens.items())
    assert all(made[k][len(t)] == model.forward(np.array(t[-size:]), weights, _TINY)[-1].argmax() for k, t in tokens.items())


def test_all_keys_are_merged(spark, tmp_path):
    spark.createDataFrame([(1, "a", '{"train/loss": 3.0, "eval/loss": 2.0}'), (2, "a", None), (3, "b", "{}")], "id bigint, name string, metrics string").write.parquet(f"{tmp_path}/experiments.parquet")
    log = [("a", "train/loss", 1.0, 1), ("a", "train/loss", None, 2), ("a", "eval/loss", 0.5, 3), ("b", "train/lr", 0.1, 4), ("b", "train/lr", 0.2, 5), ("c", "train/lr", 9.0, 6)]
    spark.createDataFrame(log, "run string, key string, value double, seq bigint").write.parquet(f"{tmp_path}/metric_log.parquet")
    found = {(r.id, r.key): r.value for r in __spark_entry__.queries()["metrics_merge"](spark, str(tmp_path)).collect()}
    assert found == {(1, "train/loss"): None, (1, "eval/loss"): 0.5, (3, "train/lr"): 0.2}
