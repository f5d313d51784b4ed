"""Vectors of hidden states: reduce positions, derive scalars, pick a pass."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import KEEP_DIMS, MAX_PASSES, REFERENCE_SIGNAL
from ..functions.signals import pass_number, position_rule
from ..functions.vectors import leading_dims, vector_scalars, vector_scalars_arrow
from .cells import latest_per_request, within_pass_budget

_KEYS = ["request_id", "signal_type", "forward_pass_index"]


def reduce_positions(hidden: DataFrame, rule: Column | None = None) -> DataFrame:
    """One vector per (request, signal, pass) from its sequence positions.

    Input: ``request_id, signal_type, forward_pass_index, position, vector``.
    Signals under the "mean" rule average over positions, the others keep the
    first position. The mean is one dense buffer per key, combined before the
    shuffle; dimensions are never exploded into rows.
    """
    rule = position_rule(F.col("signal_type")) if rule is None else rule
    averaged = (
        hidden.filter(rule == "mean")
        .groupBy(*_KEYS)
        .agg(
            vector_to_array(
                Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))
            ).alias("vector"),
            F.count(F.lit(1)).alias("n_positions"),
        )
    )
    first = (
        hidden.filter(rule == "first")
        .groupBy(*_KEYS)
        .agg(
            F.min_by("vector", "position").cast("array<double>").alias("vector"),
            F.count(F.lit(1)).alias("n_positions"),
        )
    )
    return averaged.unionByName(first)


def capture_rows(
    hidden: DataFrame,
    *,
    keep_dims: int = KEEP_DIMS,
    max_passes: int = MAX_PASSES,
    rule: Column | None = None,
) -> DataFrame:
    """Hidden states to scalar rows: budgeted passes, reduced positions, five scalars."""
    reduced = reduce_positions(within_pass_budget(hidden, max_passes), rule)
    kept = leading_dims(F.col("vector"), keep_dims)
    return reduced.withColumn("_s", vector_scalars_arrow(kept)).select(
        *_KEYS, "_s.*", "n_positions", F.size("vector").cast("long").alias("dim")
    )


def scalar_columns(vector: Column) -> list[Column]:
    return [c.alias(name) for name, c in vector_scalars(vector).items()]


def reference_vectors(
    vectors: DataFrame, signal_type: str = REFERENCE_SIGNAL, min_pass: int = 0
) -> DataFrame:
    """The reference signal's vector at its numerically highest pass, per request."""
    number = pass_number(F.col("forward_pass_index"))
    rows = vectors.filter((F.col("signal_type") == signal_type) & (number >= min_pass))
    order = F.col("id") if "id" in vectors.columns else F.lit(0)
    return latest_per_request(
        rows.select("request_id", number.alias("pass"), order.alias("id"), "vector"), ["vector"]
    )
