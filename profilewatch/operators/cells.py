"""From raw signal rows to one typed value per (request, layer, pass)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MAX_PASSES, METRIC_LAYERS, METRIC_PASSES
from ..functions.numeric import nan_to_null
from ..functions.signals import layer_of, pass_number


def order_key(rows: DataFrame, tie_break: str | Column) -> Column:
    """A row without an order value loses to every row that has one.

    Whole numbers and timestamps become one long, which a hash aggregation holds in
    place; any other type is compared as it is.
    """
    key = F.col(tie_break) if isinstance(tie_break, str) else tie_break
    kind = rows.select(key.alias("k")).schema["k"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        key = F.unix_micros(key.cast("timestamp"))
    elif not isinstance(kind, T.IntegralType):
        return F.struct(key.isNull().alias("absent"), key.alias("key"))
    return F.coalesce(key.cast("long"), F.lit((1 << 63) - 1))


def first_per_key(
    rows: DataFrame, keys: Sequence[str], values: Sequence[str], tie_break: str | Column = "id"
) -> DataFrame:
    """The row with the lowest order value of each key.

    One ``min_by`` per fixed-width value instead of a window: the buffers fit the
    hash aggregation, copies collapse before the shuffle, and a key that holds a
    third of the table arrives as one row per task.
    """
    rank = order_key(rows, tie_break)
    return rows.groupBy(*keys).agg(*[F.min_by(F.col(v), rank).alias(v) for v in values])


def latest_per_request(
    rows: DataFrame, values: Sequence[str], pass_column: str = "pass", tie_break: str = "id"
) -> DataFrame:
    """Per request the values at its highest pass, lowest id among equals."""
    rank = F.struct((-F.col(pass_column)).alias("late"), order_key(rows, tie_break).alias("order"))
    return rows.groupBy("request_id").agg(
        F.min_by(F.struct(*values), rank).alias("picked")
    ).select("request_id", "picked.*")


def typed_cells(
    rows: DataFrame,
    *,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
    value: str = "std",
    tie_break: str | Column = "id",
) -> DataFrame:
    """``request_id, layer, pass, value`` inside the metric scope, one row per cell.

    A request whose rows all lie outside the scope keeps one row with NULL layer
    and pass: it was read, so it must be countable as incomplete.
    """
    # parsed in a projection of its own: the scope test below reads the columns
    # several times, the name and the pass text are taken apart once
    parsed = rows.select(
        "request_id",
        layer_of(F.col("signal_type")).alias("layer"),
        pass_number(F.col("forward_pass_index")).alias("pass"),
        nan_to_null(F.col(value)).alias("value"),
        order_key(rows, tie_break).alias("_order"),
    )
    inside = F.col("layer").isin(list(layers)) & F.col("pass").isin(list(passes))
    scoped = parsed.select(
        "request_id", *[F.when(inside, F.col(c)).alias(c) for c in ("layer", "pass", "value")], "_order"
    )
    return first_per_key(scoped, ["request_id", "layer", "pass"], ["value"], "_order")


def unreadable_passes(rows: DataFrame) -> DataFrame:
    """How many rows carry a pass that is no number; the scope drops them."""
    return rows.agg(
        F.count_if(
            F.col("forward_pass_index").isNotNull() & pass_number(F.col("forward_pass_index")).isNull()
        ).alias("n_unreadable")
    )


def within_pass_budget(rows: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    return rows.filter(pass_number(F.col("forward_pass_index")).between(1, max_passes))


def last_generation_pass(rows: DataFrame, min_pass: int = 2) -> DataFrame:
    """Highest pass of each request that is a generated token; prefill-only requests are absent."""
    number = pass_number(F.col("forward_pass_index"))
    return (
        rows.select("request_id", number.alias("pass"))
        .filter(F.col("pass") >= min_pass)
        .groupBy("request_id")
        .agg(F.max("pass").alias("last_pass"))
    )
