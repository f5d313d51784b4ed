"""Freezing a window to disk and describing what landed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import METRIC_LAYERS, METRIC_PASSES
from ..functions.signals import layer_of, pass_number
from ..operators.band import complete_requests
from ..operators.cells import typed_cells
from .readers import Window, read_prompts, read_signals, read_table, write_csv


def census(
    prompts: DataFrame,
    scalars: DataFrame,
    *,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
) -> DataFrame:
    """Row, request and signal-type counts of a snapshot, in one row.

    Rows fold to (request, layer, pass) facts first, so every distinct count is a
    plain count of groups.
    """
    parsed = scalars.select(
        "request_id",
        layer_of(F.col("signal_type")).alias("layer"),
        pass_number(F.col("forward_pass_index")).alias("pass"),
    )
    inside = F.col("layer").isin(list(layers)) & F.col("pass").isin(list(passes))
    wanted = len(set(layers)) * len(set(passes))
    per_cell = parsed.groupBy(
        "request_id", F.when(inside, F.col("layer")).alias("layer"), F.when(inside, F.col("pass")).alias("pass")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
    per_request = per_cell.groupBy("request_id").agg(
        F.sum("n_rows").alias("n_rows"), F.count("layer").alias("n_cells")
    )
    counted = per_request.agg(
        F.count(F.lit(1)).alias("n_requests_with_signals"),
        F.count_if(F.col("n_cells") == wanted).alias("n_requests_complete"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_scalar_rows"),
    )
    types = scalars.groupBy("signal_type").count().agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        prompts.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_requests"),
        "n_requests_with_signals",
        "n_requests_complete",
        types.scalar().alias("n_signal_types"),
        "n_scalar_rows",
    )


def freeze(
    signals: DataFrame,
    payloads: DataFrame,
    folder: str,
    window: Window,
    model_id: str | None = None,
    **scope,
) -> DataFrame:
    """Write prompts and scalars of the window as CSV and return their census.

    The ids of the complete requests land beside them (``complete_ids``).
    """
    prompts = read_prompts(payloads, window, model_id)
    scalars = read_signals(signals, payloads, window, model_id=model_id)
    write_csv(prompts, f"{folder}/prompts.csv")
    write_csv(scalars, f"{folder}/scalars.csv")
    # counted on what landed, not by reading the window again
    spark = signals.sparkSession
    frozen = spark.read.csv(f"{folder}/prompts.csv", header=True, multiLine=True, quote='"', escape='"')
    landed = read_table(spark, f"{folder}/scalars.csv")
    complete = complete_requests(typed_cells(landed, tie_break=F.lit(0), **scope), **scope)
    complete.write.mode("overwrite").parquet(f"{folder}/complete")
    return census(frozen, landed, **scope)


def complete_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``request_id`` of the requests of a frozen window that have every cell of the scope."""
    return spark.read.parquet(f"{folder}/complete")


def capture_description(rows: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Sidecar of a capture: row count, signal types in order, text sizes, as JSON."""
    # one entry per signal type
    facts = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_set("signal_type")).alias("signal_types"),
    )
    if requests is not None:
        sizes = requests.agg(
            F.coalesce(F.sum("n_prompt_tokens"), F.lit(0)).cast("long").alias("n_prompt_tokens"),
            F.coalesce(F.sum("n_generated_tokens"), F.lit(0)).cast("long").alias("n_generated_tokens"),
        )
        facts = facts.withColumn("_s", sizes.select(F.struct("*").alias("s")).scalar()).select(
            "n_rows", "signal_types", "_s.*"
        )
    return facts.withColumn("json", F.to_json(F.struct("*")))
