"""Vectors as arrays of double; all functions stay expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def as_vector(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def same_size(a: Column, b: Column, value: Column) -> Column:
    """value, or an error where the vectors differ in length."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")))


def add(a: Column, b: Column) -> Column:
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x - y))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance by differences, the canonical form."""
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def sq_dist_expanded(a: Column, a_sqr: Column, b: Column, b_sqr: Column) -> Column:
    """The same from stored squared norms; near zero it may differ by rounding."""
    return a_sqr + b_sqr - 2 * dot(a, b)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def stats(a: Column) -> dict[str, Column]:
    """Columns attr_sqr, abs_sum, abs_max, abs_min and negative of a vector."""
    size = F.transform(a, F.abs)
    return {
        "attr_sqr": sq_norm(a),
        "abs_sum": _total(size),
        "abs_max": F.array_max(size),
        "abs_min": F.array_min(size),
        "negative": F.exists(a, lambda x: x < 0),
    }


def project(a: Column, rows: list[list[float]]) -> Column:
    """a times a fixed matrix given by rows, one for each target dimension."""
    return F.array(*[dot(a, F.array(*[F.lit(float(x)) for x in row])) for row in rows])


def jl_matrix(dim: int, target: int = 32, seed: int = 19260817) -> list[list[float]]:
    """A Gaussian projection to ``target`` dimensions, scaled by one over its root."""
    import numpy as np

    return (np.random.default_rng(seed).standard_normal((target, dim)) / target**0.5).tolist()
