"""Guarded arithmetic: NaN, zero width and division never leak into a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def nan_to_null(x: Column) -> Column:
    """NaN orders above every number and poisons avg/max, so ingest turns it to NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(INFINITY)), F.lit(False))


def finite(x: Column) -> Column:
    return F.when(is_finite(x), x)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def guarded_z(x: Column, mean: Column, sd: Column) -> Column:
    """Distance in band widths; 0 against a band that has no width."""
    return F.when(is_finite(sd) & (sd != 0.0), F.try_divide(x - mean, sd)).otherwise(F.lit(0.0))


def at_least(x: Column, floor: float) -> Column:
    """``x`` from ``floor`` up. ``greatest`` would turn a missing x into the floor."""
    return F.when(x < floor, F.lit(floor)).otherwise(x)


def variation(values: Column) -> Column:
    """Aggregate: population sd over |mean|, 0 where the mean says nothing."""
    mean = F.avg(values)
    return F.when(
        is_finite(mean) & (mean != 0.0), F.try_divide(F.stddev_pop(values), F.abs(mean))
    ).otherwise(F.lit(0.0))


def slope(y: Column, x: Column) -> Column:
    """Aggregate: least-squares slope over finite pairs, 0 without spread in x."""
    y = finite(y)
    x = F.when(y.isNotNull(), x.cast("double"))
    return ratio_or_zero(F.covar_pop(x, y), F.var_pop(x))


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation, 0 when a side is flat.

    The built-in ``corr`` divides by zero there, which ANSI mode turns into an error.
    """
    both = is_finite(a) & is_finite(b)
    a, b = F.when(both, a), F.when(both, b)
    return ratio_or_zero(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def equal_width_edges(lo: Column, hi: Column, n: int) -> Column:
    """n + 1 edges; the step is formed first and the last edge is ``hi`` itself."""
    step = (hi - lo) / F.lit(float(n))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda i: F.when(i == n, hi).otherwise(lo + i.cast("double") * step),
    )
