"""Exact linear-interpolation quantiles without gathering the values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Size of the mergeable sketch; its rank error at this size stays below ``_RANK_ERROR`` with 99 % certainty.
_SKETCH_K = 4_096
_RANK_ERROR = 1e-3
#: Values that one task ranks, about.
_RANKED = 1_000_000


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], ranked: int | None = None
) -> list[float | None]:
    """Quantiles as numpy's default method gives them.

    ``percentile`` keeps every distinct value in one buffer. Here a KLL sketch, merged from one
    per task, brackets each rank; a second scan keeps the values inside the brackets, equal
    ones folded to one row, in ranges of about ``ranked`` rows (a million unless given). Sizes of the ranges added up in order
    say in which range a rank lies, and only those ranges are sorted. A sketch outside its
    error bound is noticed by the counts and that rank is bracketed anew, wider. What reaches the driver
    is a row per range and two per quantile.
    """
    for p in probabilities:
        if not 0.0 <= p <= 1.0:
            raise ValueError("quantile must be in [0, 1]")
    values = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    found: dict[float, float] = {}
    margin = 2 * _RANK_ERROR
    while missing := [p for p in dict.fromkeys(probabilities) if p not in found]:
        n, brackets = _brackets(values, missing, margin)
        if n == 0:
            return [None for _ in probabilities]
        found |= _inside(values, n, brackets, margin, ranked or _RANKED)
        margin *= 8.0
    return [found[p] for p in probabilities]


def _brackets(values: DataFrame, ps: list[float], margin: float) -> tuple[int, dict[float, tuple[float, float]]]:
    """Row count and, per probability, two values that should enclose its ranks.

    The sketch leaves NaN out, which counts as the largest value; brackets are then widened.
    """
    ends = [max(0.0, p - margin) for p in ps] + [min(1.0, p + margin) for p in ps]
    sketch = values.agg(
        F.count("x").alias("n"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.kll_sketch_agg_double("x", F.lit(_SKETCH_K)).alias("sketch"),
    )
    read = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(e) for e in ends]))
    some = F.kll_sketch_get_n_double("sketch") > 0
    row = sketch.select("n", "lo", "hi", F.when(some, read).alias("read")).first()
    if not row["n"]:
        return 0, {}
    read = row["read"] or [None] * len(ends)
    low = [row["lo"] if v is None or e == 0.0 else v for e, v in zip(ends, read)][: len(ps)]
    high = [row["hi"] if v is None or e == 1.0 else v for e, v in zip(ends, read)][len(ps) :]
    return row["n"], dict(zip(ps, zip(low, high)))


def _inside(
    values: DataFrame, n: int, brackets: dict[float, tuple[float, float]], margin: float, ranked: int
) -> dict[float, float]:
    """Quantiles whose two ranks lie inside their bracket, in one scan.

    Everything below a bracket folds to one row in front of it, so the running count is a rank.
    """
    spans = list(brackets.values())
    table = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(spans)]
    )
    x = F.col("x")
    hits = F.transform(
        F.filter(table, lambda b: x <= b["hi"]),
        lambda b: F.struct(b["i"].alias("i"), F.when(x >= b["lo"], x).alias("x")),
    )
    folded = values.select(F.inline(hits)).groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
    pieces = max(1, math.ceil(len(spans) * min(1.0, 2 * margin) * n / ranked))
    order = F.asc_nulls_first("x")
    placed = settle(folded.repartitionByRange(pieces, "i", order).withColumn("piece", F.spark_partition_id()))

    sizes = placed.groupBy("i", "piece").agg(F.sum("n").alias("n")).collect()  # about a row per piece
    wanted = {i: (math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for i, p in enumerate(brackets)}
    holds, upto = [], dict.fromkeys(wanted, 0)
    for size in sorted(sizes, key=lambda r: (r["i"], r["piece"])):
        i, low = size["i"], upto[size["i"]]
        upto[i] = low + size["n"]
        holds += [(i, size["piece"], r, r - low) for r in sorted(set(wanted[i])) if low <= r < upto[i]]
    if not holds:
        return {}
    # at most two rows per quantile, sent by its size
    asked = placed.sparkSession.createDataFrame(holds, "i int, piece int, rank long, place long")
    inside = placed.join(F.broadcast(asked.select("i", "piece").distinct()), ["i", "piece"], "left_semi")
    running = F.sum("n").over(Window.partitionBy("i", "piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counted = inside.select("i", "piece", "x", "n", running.alias("upto"))
    hit = (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))
    rows = counted.join(F.broadcast(asked), ["i", "piece"]).filter(hit & x.isNotNull()).select("i", "rank", "x").collect()
    at = {(r["i"], r["rank"]): r["x"] for r in rows}
    found = {}
    for i, p in enumerate(brackets):
        low, high = wanted[i]
        if (i, low) in at and (i, high) in at:
            a, b = at[i, low], at[i, high]
            found[p] = a if a == b else a + (b - a) * (p * (n - 1) - low)
    return found
