"""Vectors, matrices, activations and losses as array expressions; all raise where dimensions do not fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAMP = 1e-15
SUM_TOLERANCE = 1e-10


def _checked(a: Column, b: Column, value: Column) -> Column:
    """zip_with pads the shorter side with nulls, so lengths are asserted."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("dimension mismatch"))).otherwise(value)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return _checked(a, b, F.zip_with(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return _checked(a, b, F.zip_with(a, b, lambda x, y: x - y))


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def dot(a: Column, b: Column) -> Column:
    return _checked(a, b, total(F.zip_with(a, b, lambda x, y: x * y)))


def magnitude(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def normalize(a: Column) -> Column:
    """A vector without length has no direction: an error."""
    m = magnitude(a)
    return F.when(m == 0, F.raise_error(F.lit("zero magnitude"))).otherwise(F.transform(a, lambda x: x / m))


def get(a: Column, index: Column | int) -> Column:
    """0-based; out of bounds is an error."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.when((at < 0) | (at >= F.size(a)), F.raise_error(F.lit("index out of bounds"))).otherwise(F.get(a, at))


def matrix_add(a: Column, b: Column) -> Column:
    return _checked(a, b, F.zip_with(a, b, add))


def matrix_subtract(a: Column, b: Column) -> Column:
    return _checked(a, b, F.zip_with(a, b, subtract))


def matrix_scale(m: Column, k: Column | float) -> Column:
    return F.transform(m, lambda r: scale(r, k))


def transpose(m: Column) -> Column:
    """An empty matrix stays empty."""
    width = F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))
    return F.when(width <= 0, m).otherwise(F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(m, lambda r: F.get(r, j))))


def identity(n: int) -> Column:
    return F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(n)]) for i in range(n)])


def zeros(rows: int, cols: int) -> Column:
    return F.array(*[F.array(*[F.lit(0.0)] * cols) for _ in range(rows)])


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda r: dot(r, v))


def matmul(a: Column, b: Column) -> Column:
    """Small matrices held in one row; long-form matrices multiply by a join (operators.matrices)."""
    t = transpose(b)
    return F.transform(a, lambda r: F.transform(t, lambda c: dot(r, c)))


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def slope(kind: str, output: Column) -> Column:
    """The derivative of a scalar activation, from its output; softmax has none."""
    return {"linear": F.lit(1.0), "relu": F.when(output > 0, 1.0).otherwise(0.0), "tanh": 1 - output * output, "sigmoid": output * (1 - output)}.get(kind, F.lit(None).cast("double"))


def argmax_last(a: Column) -> Column:
    """0-based place of the greatest value; among equals the last."""
    return F.array_max(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def squared_error(p: Column, t: Column) -> Column:
    """Mean over the places of one vector."""
    d = subtract(p, t)
    return total(F.transform(d, lambda x: x * x)) / F.size(p)


def squared_error_gradient(p: Column, t: Column) -> Column:
    return F.transform(subtract(p, t), lambda d: 2 * d / F.size(p))


def clamp(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLAMP)), F.lit(1 - CLAMP))


def binary_cross_entropy(p: Column, t: Column) -> Column:
    """Of one scalar probability."""
    q = clamp(p)
    return -(t * F.ln(q) + (1 - t) * F.ln(1 - q))


def binary_cross_entropy_gradient(p: Column, t: Column) -> Column:
    q = clamp(p)
    return (q - t) / (q * (1 - q))


def cross_entropy(p: Column, t: Column) -> Column:
    """A sum over the classes, not a mean; both sides must be distributions."""
    off = (F.abs(total(p) - 1) > SUM_TOLERANCE) | (F.abs(total(t) - 1) > SUM_TOLERANCE)
    return F.when(off, F.raise_error(F.lit("not a distribution"))).otherwise(_checked(p, t, total(F.zip_with(p, t, lambda x, y: -y * F.ln(clamp(x))))))


def cross_entropy_gradient(p: Column, t: Column) -> Column:
    return _checked(p, t, F.zip_with(p, t, lambda x, y: -y / clamp(x)))
