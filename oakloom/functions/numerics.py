"""Numerics over array columns: normalisation, rotary embedding, softmax, cross-entropy. Doubles throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once; in a lambda over an array it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean_square(x: Column | str) -> Column:
    x = _doubles(x)
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v), F.size(x))


def rms_norm(x: Column | str, weight: Column | float = 1.0, eps: float = 1e-6) -> Column:
    """w * x / sqrt(mean(x^2) + eps). weight is an array column or one number."""
    x = _doubles(x)
    scale = 1 / F.sqrt(mean_square(x) + eps)
    if isinstance(weight, Column):
        return bound(scale, lambda s: F.zip_with(x, weight, lambda a, w: w * a * s))
    return bound(scale, lambda s: F.transform(x, lambda a: a * weight * s))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_doubles(a), _doubles(b), lambda p, q: p * q))


def softmax(x: Column | str, temperature: float = 1.0) -> Column:
    """exp((x - max) / t) over its sum. A temperature of 0 has no distribution and is refused."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    x = _doubles(x)
    raised = bound(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp((v - m) / temperature)))
    return bound(raised, lambda r: bound(total(r), lambda t: F.transform(r, lambda v: v / t)))


def log_sum_exp(x: Column | str) -> Column:
    x = _doubles(x)
    return bound(F.array_max(x), lambda m: m + F.log(total(F.transform(x, lambda v: F.exp(v - m)))))


def cross_entropy(logits: Column | str, target: Column | str, ignore: int = -100) -> Column:
    """Loss of one position; null where the target is to be ignored."""
    target = F.col(target) if isinstance(target, str) else target
    return F.when(target != ignore, log_sum_exp(logits) - F.get(_doubles(logits), target.cast("int")))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def rope_tables(dim: int, length: int, base: float = 10_000.0) -> tuple[list[list[float]], list[list[float]]]:
    """(cos, sin) by position, each of ``dim`` values: the half dimensions' angles twice. Made once by the driver."""
    inverse = [1.0 / base ** (2 * i / dim) for i in range(dim // 2)]
    angles = [[p * f for f in inverse] * 2 for p in range(length)]
    return [[math.cos(a) for a in row] for row in angles], [[math.sin(a) for a in row] for row in angles]


def rope_angle(position: Column, index: Column, dim: int, base: float = 10_000.0) -> Column:
    """Angle of the index-th dimension at a position."""
    return position / F.pow(F.lit(base), 2 * F.pmod(index, F.lit(dim // 2)) / dim)


def apply_rope(x: Column | str, position: Column | str, dim: int, base: float = 10_000.0) -> Column:
    """x * cos + rotated(x) * sin, where the second half, negated, comes before the first."""
    x = _doubles(x)
    position = F.col(position) if isinstance(position, str) else position
    half = dim // 2

    def one(v: Column, i: Column) -> Column:
        turned = F.when(i < half, -F.get(x, i + half)).otherwise(F.get(x, i - half))
        angle = rope_angle(position, i, dim, base)
        return v * F.cos(angle) + turned * F.sin(angle)

    return F.transform(x, one)


def norm_scale(gradient: Column | str, most: float = 1.0) -> Column:
    """Factor that clips a gradient vector to the norm ``most``."""
    return F.least(F.lit(1.0), most / (F.sqrt(total(F.transform(_doubles(gradient), lambda g: g * g))) + 1e-6))


def attends(query: Column, key: Column) -> Column:
    """Causal mask: a position sees itself and what stands before it."""
    return key <= query
