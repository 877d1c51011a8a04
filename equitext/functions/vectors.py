"""Dense-vector column functions (F4-F8) on ``array<double>`` columns.

All are built-in higher-order functions, evaluated in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(values: Sequence[float]) -> Column:
    """A constant vector (a direction or a coefficient vector)."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column | str, b: Column | str) -> Column:
    """sum of element-wise products."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """a / |a|; the zero vector stays zero.  The norm is evaluated once
    per row (repeated into an array), not once per element."""
    a = _c(a)
    n = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, n, lambda x, m: F.when(m > 0, x / m).otherwise(x))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def axpy(v: Column | str, terms: Sequence[tuple[Column | float, Column | str]]) -> Column:
    """v + sum_i c_i * d_i for scalar columns c_i and vector columns d_i."""

    def add(out: Column, c: Column, d: Column) -> Column:
        return F.zip_with(out, d, lambda x, y: x + c * y)

    out = _c(v)
    for coef, d in terms:
        out = add(out, coef if isinstance(coef, Column) else F.lit(float(coef)), _c(d))
    return out


def sigmoid(z: Column) -> Column:
    """logistic probability 1 / (1 + e^-z)."""
    return 1.0 / (1.0 + F.exp(-z))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
