"""Whether two nodes lie farther apart than r, with bounds that spare exact distances.

A predicate takes two structs of node columns and r squared, and gives a boolean
Column.  Bounds decide where they can; only else is the exact distance folded.
Equality is allowed: a pair violates only if its squared distance is greater.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import vectors as V

PairPredicate = Callable[[Column, Column, float], Column]
Bounds = tuple[Column, Column]


def exact(a: Column, b: Column, rr: float) -> Column:
    return V.sq_dist(a["attrs"], b["attrs"]) > rr


def stat_bounds(a: Column, b: Column) -> Bounds:
    """Lower and upper bounds of the squared distance from sums and extremes of absolute components."""
    s = a["attr_sqr"] + b["attr_sqr"]
    most = F.least(a["abs_sum"] * b["abs_max"], b["abs_sum"] * a["abs_max"])
    least = F.greatest(a["abs_sum"] * b["abs_min"], b["abs_sum"] * a["abs_min"])
    signed = a["negative"] | b["negative"]
    return s - 2 * most, F.when(signed, s + 2 * most).otherwise(s - 2 * least)


def norm_bounds(a: Column, b: Column) -> Bounds:
    """By statistics for non-negative vectors, by Cauchy and Schwarz for signed ones."""
    lo, hi = stat_bounds(a, b)
    s, t = a["attr_sqr"] + b["attr_sqr"], 2 * F.sqrt(a["attr_sqr"] * b["attr_sqr"])
    signed = a["negative"] | b["negative"]
    return F.when(signed, s - t).otherwise(lo), F.when(signed, s + t).otherwise(hi)


def _pivot_columns(a: Column, b: Column, pivot_d2: Column) -> tuple[Column, ...]:
    p, q, k = a["pivot"], b["pivot"], F.size(a["d2s"])
    return a["d2s"][p], a["d2s"][q], b["d2s"][p], b["d2s"][q], F.get(pivot_d2, p * k + q)


def bipolar_bounds(a: Column, b: Column, pivot_d2: Column) -> Bounds:
    """Both points seen from both pivots: the parts along the pivots' line are known, those across it are bounded.

    With one pivot for both, the difference and the sum of the distances to it.
    """
    a1, a2, b1, b2, s = _pivot_columns(a, b, pivot_d2)
    alpha, beta = (a1 + s - a2) / 2, (b1 + s - b2) / 2
    apart = s > 1e-9
    safe = F.when(apart, s).otherwise(1.0)
    f = a1 + b1 - 2 * alpha * beta / safe
    t = 2 * F.sqrt(F.greatest(F.lit(0.0), a1 - alpha * alpha / safe) * F.greatest(F.lit(0.0), b1 - beta * beta / safe))
    near, far = F.sqrt(a1) - F.sqrt(b1), F.sqrt(a1) + F.sqrt(b1)
    return F.when(apart, f - t).otherwise(near * near), F.when(apart, f + t).otherwise(far * far)


def triangle_bounds(a: Column, b: Column, pivot_d2: Column) -> Bounds:
    """The triangle inequality through either pivot."""
    a1, a2, b1, b2, _ = _pivot_columns(a, b, pivot_d2)
    lo = F.greatest(F.abs(F.sqrt(a1) - F.sqrt(b1)), F.abs(F.sqrt(a2) - F.sqrt(b2)))
    hi = F.least(F.sqrt(a1) + F.sqrt(b1), F.sqrt(a2) + F.sqrt(b2))
    return lo * lo, hi * hi


def centroid_bounds(a: Column, b: Column, pivot_d2: Column) -> Bounds:
    """Triangle bounds with the path over both pivots."""
    a1, _, b1, _, s = _pivot_columns(a, b, pivot_d2)
    lo, hi = triangle_bounds(a, b, pivot_d2)
    path = F.sqrt(a1) + F.sqrt(s) + F.sqrt(b1)
    return lo, F.least(hi, path * path)


def decide(bounds: Bounds, rr: float) -> Column:
    """True or false where the bounds decide with a margin for rounding, else null."""
    lo, hi = bounds
    eps = 1e-9 * (1 + abs(rr))
    return F.when(lo > rr + eps, True).when(hi < rr - eps, False)


def predicate(kind: str, pivot_d2: list[float] | None = None) -> PairPredicate:
    """none, stat, bipolar, triangle, centroid, hybrid (norms, then bipolar), triangle_hybrid, or both (bipolar, triangle, norms)."""
    table = F.array(*map(F.lit, pivot_d2)) if pivot_d2 is not None else None
    steps: dict[str, list] = {
        "none": [],
        "stat": [stat_bounds],
        "bipolar": [bipolar_bounds],
        "triangle": [triangle_bounds],
        "centroid": [stat_bounds, centroid_bounds],
        "hybrid": [norm_bounds, bipolar_bounds],
        "triangle_hybrid": [norm_bounds, triangle_bounds],
        "both": [bipolar_bounds, triangle_bounds, norm_bounds],
    }
    chosen = steps[kind]
    if table is None and any(f in (bipolar_bounds, triangle_bounds, centroid_bounds) for f in chosen):
        raise ValueError(f"{kind} needs a pivot index")

    def decided(a: Column, b: Column, rr: float) -> Column:
        got = [decide(f(a, b) if f in (stat_bounds, norm_bounds) else f(a, b, table), rr) for f in chosen]
        return F.coalesce(*got) if got else F.lit(None).cast("boolean")

    def test(a: Column, b: Column, rr: float) -> Column:
        return F.coalesce(decided(a, b, rr), exact(a, b, rr))

    test.decided = decided  # type: ignore[attr-defined]
    test.steps, test.table = [f.__name__.removesuffix("_bounds") for f in chosen], pivot_d2  # type: ignore[attr-defined]
    test.columns = ["attrs", *(("attr_sqr", "abs_sum", "abs_max", "abs_min", "negative") if any(f in (stat_bounds, norm_bounds) for f in chosen) else ()), *(("pivot", "d2s") if table is not None else ())]  # type: ignore[attr-defined]
    return test
