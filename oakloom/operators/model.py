"""A small decoder-only transformer in NumPy, applied to rows of tokens in Arrow batches.

Root-mean-square norms, rotary positions, causal attention, gated feed-forward layers, tied output weights.
Weights are made by the driver from a seed or given, and broadcast; their size is known from the configuration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ModelConfig:
    vocab_size: int = 6400
    n_embed: int = 512
    n_layer: int = 8
    n_head: int = 8
    max_seq_len: int = 512
    hidden_dim: int | None = None
    tie_weights: bool = True

    @property
    def hidden(self) -> int:
        return self.hidden_dim or 4 * self.n_embed

    def parameters(self) -> dict[str, tuple[int, ...]]:
        """Shapes by name."""
        d, h = self.n_embed, self.hidden
        shapes: dict[str, tuple[int, ...]] = {"token_embedding.weight": (self.vocab_size, d)}
        for i in range(self.n_layer):
            shapes |= {f"blocks.{i}.norm1.weight": (d,), f"blocks.{i}.norm2.weight": (d,)}
            shapes |= {f"blocks.{i}.attention.{x}.weight": (d, d) for x in ("q", "k", "v", "out")}
            shapes |= {f"blocks.{i}.ffn.w1.weight": (d, h), f"blocks.{i}.ffn.w2.weight": (d, h), f"blocks.{i}.ffn.w3.weight": (h, d)}
        shapes["norm.weight"] = (d,)
        if not self.tie_weights:
            shapes["head.weight"] = (self.vocab_size, d)
        return shapes

    def count(self) -> int:
        return sum(int(np.prod(s)) for s in self.parameters().values())


def initial_weights(config: ModelConfig, seed: int = 42) -> dict[str, np.ndarray]:
    """Normal weights of deviation 0.02, norms of ones."""
    draw = np.random.default_rng(seed)
    return {n: np.ones(s) if "norm" in n else draw.normal(0, 0.02, s) for n, s in config.parameters().items()}


def _norm(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + 1e-6) * w


def _turned(x: np.ndarray) -> np.ndarray:
    """Rotary positions over (heads, positions, dimensions)."""
    t, d = x.shape[-2:]
    angle = np.arange(t)[:, None] * (1.0 / 10_000.0 ** (np.arange(0, d, 2) / d))[None, :]
    cos, sin = (np.tile(f(angle), 2) for f in (np.cos, np.sin))
    return x * cos + np.concatenate([-x[..., d // 2 :], x[..., : d // 2]], axis=-1) * sin


def forward(tokens: np.ndarray, weights: dict[str, np.ndarray], config: ModelConfig) -> np.ndarray:
    """(..., positions, vocabulary): logits of one sequence or of a batch of sequences of one width; what stands right of a position doesn't change it."""
    x = weights["token_embedding.weight"][tokens]
    t, heads = x.shape[-2], config.n_head
    ahead = np.triu(np.full((t, t), -np.inf), 1)
    for i in range(config.n_layer):
        b = f"blocks.{i}."
        n = _norm(x, weights[b + "norm1.weight"])
        q, k, v = (np.moveaxis((n @ weights[f"{b}attention.{p}.weight"]).reshape(*n.shape[:-1], heads, -1), -2, -3) for p in "qkv")
        scores = _turned(q) @ np.swapaxes(_turned(k), -1, -2) / np.sqrt(q.shape[-1]) + ahead
        share = np.exp(scores - scores.max(axis=-1, keepdims=True))
        share /= share.sum(axis=-1, keepdims=True)
        x = x + np.moveaxis(share @ v, -3, -2).reshape(x.shape) @ weights[b + "attention.out.weight"]
        n = _norm(x, weights[b + "norm2.weight"])
        gate = n @ weights[b + "ffn.w1.weight"]
        x = x + (gate / (1 + np.exp(-gate)) * (n @ weights[b + "ffn.w2.weight"])) @ weights[b + "ffn.w3.weight"]
    head = weights["token_embedding.weight" if config.tie_weights else "head.weight"]
    return _norm(x, weights["norm.weight"]) @ head.T


def _grouped(sequences: list[np.ndarray], config: ModelConfig, budget: int = 4_000_000):
    """(indices, tokens) of sequences that aren't empty, padded on the right; of much the same length, and as many as keep the logits under the budget."""
    order = sorted((k for k, x in enumerate(sequences) if len(x)), key=lambda k: len(sequences[k]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * len(sequences[order[upto]]) * config.vocab_size <= budget:
            upto += 1
        some = order[at:upto]
        tokens = np.zeros((len(some), len(sequences[some[-1]])), np.int64)
        for row, k in enumerate(some):
            tokens[row, : len(sequences[k])] = sequences[k]
        yield some, tokens
        at = upto


def _checked(tokens, config: ModelConfig) -> np.ndarray:
    tokens = np.asarray([] if tokens is None else tokens, np.int64)
    if len(tokens) and tokens.max() >= config.vocab_size:
        raise ValueError(f"token {tokens.max()} is outside a vocabulary of {config.vocab_size}")
    return tokens


def sequence_losses(samples: DataFrame, key: str, weights: dict[str, np.ndarray], config: ModelConfig, ignore: int = -100) -> DataFrame:
    """(key, position, loss) of input_ids against labels; ignored labels give no row, empty samples neither."""
    sent = samples.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import pandas as pd

        for batch in batches:
            names, labels = batch[key].tolist(), batch["labels"].tolist()
            sequences = [_checked(x, config)[: config.max_seq_len] for x in batch["input_ids"]]
            rows = []
            for some, tokens in _grouped(sequences, config):
                logits = forward(tokens, sent.value, config)
                high = logits.max(axis=-1)
                total = high + np.log(np.exp(logits - high[..., None]).sum(axis=-1))
                for row, k in enumerate(some):
                    y = np.asarray(labels[k], np.int64)[: len(sequences[k])]
                    at = np.flatnonzero(y != ignore)
                    loss = total[row, at] - logits[row, at, y[at]]
                    rows.append(pd.DataFrame({key: names[k], "position": at.astype(np.int32), "loss": loss}))
            yield pd.concat(rows) if rows else pd.DataFrame({key: pd.Series(dtype="int64"), "position": pd.Series(dtype="int32"), "loss": pd.Series(dtype="float64")})

    return samples.select(key, "input_ids", "labels").mapInPandas(run, f"{key} bigint, position int, loss double")


def last_logits(samples: DataFrame, key: str | list[str], tokens: str, weights: dict[str, np.ndarray], config: ModelConfig) -> DataFrame:
    """(key, logits): logits after the last token of each row; only the last max_seq_len tokens are seen; null for rows without tokens."""
    keys = [key] if isinstance(key, str) else key
    sent = samples.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            out = batch[keys].copy()
            sequences = [_checked(x, config)[-config.max_seq_len :] for x in batch[tokens]]
            last: list = [None] * len(sequences)
            for some, padded in _grouped(sequences, config):
                logits = forward(padded, sent.value, config)
                for row, k in enumerate(some):
                    last[k] = logits[row, len(sequences[k]) - 1].tolist()
            out["logits"] = last
            yield out

    return samples.select(*keys, tokens).mapInPandas(run, ", ".join(f"{k} bigint" for k in keys) + ", logits array<double>")


def generated(
    prompts: DataFrame, key: str, tokens: str, weights: dict[str, np.ndarray], config: ModelConfig, new_tokens: int, temperature: float = 0.0, top_p: float = 0.9, seed: int = 42, end: int | None = None
) -> DataFrame:
    """(key, tokens): each prompt with up to ``new_tokens`` more, which stop after ``end``.

    A temperature of 0 takes the likeliest token, ties the smaller; above, the nucleus is drawn from with a generator seeded by
    seed and key, whatever the partition. The prompt is never cut from the result; the model sees its last max_seq_len tokens.
    """
    sent = prompts.sparkSession.sparkContext.broadcast(weights)

    def pick(logits: np.ndarray, draw) -> int:
        if temperature <= 0:
            return int(logits.argmax())
        order = np.argsort(-logits, kind="stable")
        p = np.exp((logits[order] - logits[order[0]]) / temperature)
        p /= p.sum()
        kept = (np.cumsum(p) <= top_p) | (np.arange(len(p)) == 0) if top_p < 1 else np.ones(len(p), bool)
        p = np.where(kept, p, 0)
        return int(order[draw.choice(len(p), p=p / p.sum())])

    def run(batches):
        for batch in batches:
            out = batch[[key]].copy()
            said = [_checked(x, config).tolist() for x in batch[tokens]]
            draws = [np.random.default_rng([seed, int(n)]) for n in batch[key]]
            going = [bool(x) for x in said]
            for _ in range(new_tokens):
                seen = [np.asarray(x[-config.max_seq_len :] if on else [], np.int64) for x, on in zip(said, going)]
                for some, padded in _grouped(seen, config):
                    logits = forward(padded, sent.value, config)
                    for row, k in enumerate(some):
                        token = pick(logits[row, len(seen[k]) - 1], draws[k])
                        said[k].append(token)
                        going[k] = token != end
            out["tokens"] = said
            yield out

    return prompts.select(key, tokens).mapInPandas(run, f"{key} bigint, tokens array<bigint>")
