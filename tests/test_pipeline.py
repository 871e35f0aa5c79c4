import math

import numpy as np

from oakloom.operators import model
from oakloom.plans import pipeline


def test_chain_from_files_to_perplexity(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "b.txt").write_text("  second file, first line \nshort\n")
    (raw / "a.txt").write_text("first file, first line\r\n\n")
    (raw / "val.txt").write_text("held out line of some length\n")
    stats = pipeline.preprocess(spark, str(raw), str(tmp_path / "clean"), held_out=("val.txt",)).first()
    assert tuple(stats) == (4, 2, 45)
    clean = "first file, first line\nsecond file, first line\n"
    assert "".join(p.read_text() for p in sorted((tmp_path / "clean").glob("part-*"))) == clean
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "1.txt").write_text(clean)
    (tmp_path / "text" / "2.txt").write_text("and more")
    config = model.ModelConfig(vocab_size=128, n_embed=16, n_layer=1, n_head=2, max_seq_len=16)
    samples = pipeline.training_windows(spark, str(tmp_path / "text"), 16, 8, 128)
    stream = [ord(c) for c in clean + "and more"]
    rows = {r.k: (r.input_ids, r.labels) for r in samples.collect()}
    assert rows == {k: (stream[i : i + 16], stream[i + 1 : i + 17]) for k, i in enumerate(range(0, len(stream) - 16, 8))}
    weights = model.initial_weights(config)
    got = pipeline.evaluate(samples, weights, config, 2).first()

    def loss(ids, labels):
        logits = model.forward(np.array(ids), weights, config)
        return float(np.mean(np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(labels)), labels]))

    means = [np.mean([loss(*rows[k]) for k in (j, j + 1) if k in rows]) for j in range(0, len(rows), 2)]
    assert math.isclose(got.eval_loss, np.mean(means)) and math.isclose(got.perplexity, math.exp(np.mean(means)))
