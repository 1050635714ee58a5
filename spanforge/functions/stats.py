"""Ratios and intervals used by the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column, digits: int | None = 4, empty: float | None = 0.0) -> Column:
    out = F.when(den != 0, num.cast("double") / den)
    if empty is not None:
        out = F.coalesce(out, F.lit(float(empty)))
    return out if digits is None else F.bround(out, digits)


def mean_in_order(value: Column | str, *order: Column | str) -> Column:
    """Aggregate: the mean of the doubles added up in the given order, nulls left out.

    Unlike ``avg`` it gives the same double however the rows are dealt, which counts where a
    mean meets a threshold or a rounding.  It gathers a group's values: for bounded groups.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)], v.cast("double").alias("v")))))
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["v"]) / F.nullif(F.size(rows), F.lit(0))


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean, zero when both are zero."""
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column, digits: int = 4) -> list[Column]:
    """Columns ``p, r, f1``, zero-safe."""
    p, r = ratio(tp, tp + fp, None), ratio(tp, tp + fn, None)
    return [F.bround(p, digits).alias("p"), F.bround(r, digits).alias("r"), F.bround(f1(p, r), digits).alias("f1")]


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval."""
    n = n.cast("double")
    p = successes / n
    z2 = F.lit(z * z)
    mid = p + z2 / (2 * n)
    half = F.lit(z) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)
