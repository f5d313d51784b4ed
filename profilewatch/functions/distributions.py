"""Chi-square and Student-t probabilities as column expressions.

Both are sums of fixed length, so they stay in the JVM. Constants that depend only on
the degrees of freedom, or on nothing, come from the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: erfc(sqrt(h)) is below 1e-18 for h from here on, so 220 terms reach the last bit of a double.
_ERF_ONE_FROM = 40.0
#: Natural logarithms by which an integrand falls before the rest is left out: exp(-50) of the start.
_DROPPED = 50.0
_PANELS, _POINTS = 12, 16


def erf(z: Column) -> Column:
    """Error function for z >= 0, by the all-positive series of z * exp(-z^2)."""
    h = z * z
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(220)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * h * 2.0 / (2.0 * n + 1.0)).alias("term"),
            (acc["total"] + acc["term"] * h * 2.0 / (2.0 * n + 1.0)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(h > _ERF_ONE_FROM, F.lit(1.0)).otherwise(
        F.lit(2.0 / math.sqrt(math.pi)) * z * F.exp(-h) * series
    )


def chi_square_cdf(x: Column, df: int) -> Column:
    """P(X <= x) for a chi-square variable with ``df`` degrees of freedom.

    Terms are formed in logarithms, so neither a large x nor a large df overflows.
    """
    if df < 1:
        raise ValueError("df must be at least 1")
    h = x / 2.0
    odd = df % 2
    powers = [i + 0.5 * odd for i in range((df - odd) // 2)]
    start = erf(F.sqrt(h)) if odd else F.lit(1.0)
    if powers:
        terms = F.array(
            *[
                F.struct(F.lit(p).alias("p"), F.lit(math.lgamma(p + 1.0)).alias("g"))
                for p in powers
            ]
        )
        log_h = F.ln(h)
        tail = F.aggregate(
            terms, F.lit(0.0), lambda acc, t: acc + F.exp(t["p"] * log_h - h - t["g"])
        )
    else:
        tail = F.lit(0.0)
    inside = start - tail
    return F.when((x <= 0.0) | (inside < 0.0), F.lit(0.0)).when(inside > 1.0, F.lit(1.0)).otherwise(inside)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value for whole ``df`` of any size.

    With t = sqrt(df) tan(angle) the density is a power of the cosine, so the
    p-value is a ratio of two integrals of cos(angle)^(df - 1): from the angle of t, and from 0, to a
    right angle. Both are Gauss-Legendre sums over the part of the range where the integrand is above
    exp(-50) of its start. The tail is summed by itself, so a small p keeps its digits.
    """
    power = df.cast("double") - 1.0
    start = F.atan(F.abs(t) / F.sqrt(power + 1.0))
    log_start = power * _log_cosine(start)
    tail = _cosine_integral(start, power, log_start)
    whole = _cosine_integral(F.lit(0.0), power, F.lit(0.0))
    p = F.exp(log_start) * tail / whole
    return F.when(t.isNull() | df.isNull() | (df < 1), F.lit(None).cast("double")).otherwise(
        F.when(p > 1.0, F.lit(1.0)).otherwise(p)
    )


def _log_cosine(angle: Column) -> Column:
    return F.lit(0.5) * F.log1p(-F.sin(angle) * F.sin(angle))


def _cosine_integral(start: Column, power: Column, log_start: Column) -> Column:
    """Integral of (cos(angle) / cos(start))^power from ``start`` to a right angle."""
    # ln cos falls at least as fast as -angle^2 / 2
    reach = F.sqrt(start * start + 2.0 * _DROPPED / F.greatest(power, F.lit(1e-9)))
    width = F.least(F.lit(math.pi / 2), reach) - start
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _quadrature()])
    total = F.aggregate(
        nodes,
        F.lit(0.0),
        lambda acc, n: acc + n["w"] * F.exp(power * _log_cosine(start + width * n["x"]) - log_start),
    )
    return width * total


def _quadrature() -> list[tuple[float, float]]:
    """Nodes and weights on 0..1: equal panels with a Gauss-Legendre rule each."""
    x, w = np.polynomial.legendre.leggauss(_POINTS)
    panels = np.arange(_PANELS)[:, None]
    nodes = (panels + (x + 1.0) / 2.0) / _PANELS
    return list(zip(nodes.ravel().tolist(), np.tile(w / 2.0 / _PANELS, _PANELS).tolist(), strict=True))
