"""The window panel on a stream of signal rows.

Every step is a chained windowed aggregation in append mode: a window leaves a
step when the watermark passes it and is then final. State is one fixed-size
buffer per group; no step collects the rows of a request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import CELL_KEYS, METRIC_LAYERS, METRIC_PASSES, MIN_PASSES, SCORE_BANDS
from ..functions.numeric import guarded_z, nan_to_null
from ..operators.band import Band
from ..operators.panel import distribution_by
from ..operators.profile import axis_aggregates, axis_entries, is_flattened, request_measures
from ..session import scratch_path


def streaming_cells(
    stream: DataFrame,
    every: str,
    delay: str,
    *,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
    tie_break: str = "id",
) -> DataFrame:
    """``request_id, layer, pass, value`` per window; the lowest id wins a double write.

    ``stream``: ``time, request_id, layer, pass, value`` and the tie-break. As in the batch
    path, NaN is missing, and a request whose rows all lie outside the scope keeps one
    cell without layer and pass, so that it counts as incomplete.
    """
    inside = F.col("layer").isin(list(layers)) & F.col("pass").isin(list(passes))
    scoped = stream.withWatermark("time", delay).select(
        "time", "request_id", tie_break,
        F.when(inside, F.col("layer")).alias("layer"),
        F.when(inside, F.col("pass")).alias("pass"),
        F.when(inside, nan_to_null(F.col("value"))).alias("value"),
    )
    return (
        scoped.groupBy(F.window("time", every).alias("w"), "request_id", "layer", "pass")
        .agg(F.min_by("value", tie_break).alias("value"))
        .select(F.window_time("w").alias("time"), "request_id", "layer", "pass", "value")
    )


def streaming_scores(
    stream: DataFrame,
    every: str,
    delay: str,
    *,
    band: Band | None = None,
    cv_mean: float | None = None,
    cv_sd: float | None = None,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
    min_passes: int = MIN_PASSES,
    **flag,
) -> DataFrame:
    """Every score of every (window, request), as ``panel.read_request_scores`` gives them.

    With a ``band`` also ``corr`` and ``max_abs_z_layer``: its scalars are read when the
    stream is built, its layers are a static table joined by layer. Without one the healthy
    mean and deviation come as numbers. State is one row per (window, request, axis, position)
    and one of co-moments per (window, request).
    """
    if band is not None:
        healthy = band.frame.select("cv_mean", "cv_sd").first()
        cv_mean, cv_sd = healthy["cv_mean"], healthy["cv_sd"]
    cells = streaming_cells(stream, every, delay, layers=layers, passes=passes)
    marginals = (
        axis_entries(cells, "time")
        .groupBy(F.window("time", every).alias("w"), "request_id", "axis", "at")
        .agg(*axis_aggregates())
        .select(F.window_time("w").alias("time"), "request_id", "axis", "at", "mean", "cv", "n_values", "n_cells")
    )
    if band is not None:
        shape = band.layer().select(
            F.lit("layer").alias("axis"), F.col("layer").alias("at"),
            F.col("profile_mean").alias("band_mean"), F.col("profile_sd").alias("band_sd"),
        )
        marginals = marginals.join(shape, ["axis", "at"], "left")
    requests = marginals.groupBy(F.window("time", every).alias("w"), "request_id").agg(
        *request_measures(sorted(set(passes)), band is not None)
    )
    enough = F.col("n_passes_used") >= min_passes
    z = guarded_z(F.col("cv"), F.lit(cv_mean), F.lit(cv_sd))
    scored = {"cv": F.col("cv"), "z_cv": z}
    if band is not None:
        scored |= {c: F.col(c) for c in ("corr", "max_abs_z_layer")}
    scored |= {c: F.col(c) for c in ("slope", "cv_pass_slope")}
    scored["is_flattened"] = is_flattened(z, **flag)
    return requests.select(
        F.window_time("w").alias("time"),
        F.col("w.start").alias("window_start"),
        "request_id",
        "n_passes_used",
        *[F.when(enough, c).alias(name) for name, c in scored.items()],
    )


def streaming_summary(scores: DataFrame, every: str) -> DataFrame:
    """Window summary of the scored requests, one row per finished window.

    ``mean_corr`` is there when the scores were made with a band.
    """
    scored = F.col("cv").isNotNull()
    means = [c for c in ("cv", "z_cv", "corr") if c in scores.columns]
    flattened = F.coalesce(F.avg(F.col("is_flattened").cast("double")), F.lit(0.0))
    return (
        scores.groupBy(F.window("time", every).alias("w"))
        .agg(
            flattened.alias("flattened_rate"),
            (F.lit(1.0) - flattened).alias("healthy_rate"),
            F.count_if(scored).alias("sample_count"),
            *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in means],
            F.count_if(~scored).alias("n_incomplete"),
        )
        .select(F.col("w.start").alias("window_start"), "flattened_rate", "healthy_rate", "sample_count",
                *[f"mean_{c}" for c in means], "n_incomplete")
    )


def start_distribution(
    scores: DataFrame, path: str, column: str = "z_cv", n_bands: int = SCORE_BANDS
) -> StreamingQuery:
    """Histogram of the scores of every finished window, as ``panel.distribution_by`` gives it.

    The observed range is known only when a window is finished. Append mode hands out all
    requests of a window in the batch in which the watermark passes it, so a batch holds whole
    windows. A batch that is tried again overwrites its own folder.
    """
    def store(batch: DataFrame, number: int) -> None:
        found = distribution_by(batch.drop("time"), "window_start", column, n_bands)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        scores.writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def drop_double_writes(stream: DataFrame, delay: str, time: str = "time") -> DataFrame:
    """Rows of a key written more than once pass once, the one that arrives first, without waiting."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(CELL_KEYS)


def lowest_of_double_writes(
    stream: DataFrame, gap: str, delay: str, values: Sequence[str], time: str = "time", tie_break: str = "id"
) -> DataFrame:
    """One row per key of a double write: the one with the lowest order value, whichever arrived first.

    Copies of a key less than ``gap`` apart are one write: they fold in a session of their key,
    which holds one row and leaves the state when the watermark passes its end. Returns the keys, the
    times of the first and last copy, the order value, ``values`` and the number of copies.
    """
    picked = F.min_by(F.struct(*values), tie_break)
    folded = (
        stream.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), *CELL_KEYS)
        .agg(
            F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.min(tie_break).alias(tie_break),
            picked.alias("picked"), F.count(F.lit(1)).alias("n_copies"),
        )
    )
    return folded.select(*CELL_KEYS, "first_time", "last_time", tie_break, "picked.*", "n_copies")


def capture_progress(stream: DataFrame, every: str, delay: str, expected: int) -> DataFrame:
    """Requests seen against expected, exact per finished window.

    A distinct count is refused on streams; grouping by request first and counting
    the groups is the same number.
    """
    seen = (
        stream.withWatermark("time", delay)
        .groupBy(F.window("time", every).alias("w"), "request_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.window_time("w").alias("time"), "n_rows")
    )
    return (
        seen.groupBy(F.window("time", every).alias("w"))
        .agg(F.count(F.lit(1)).alias("seen"), F.sum("n_rows").alias("n_rows"))
        .select(
            F.col("w.start").alias("window_start"),
            "seen",
            F.lit(expected).cast("long").alias("expected"),
            (F.col("seen") >= expected).alias("complete"),
            "n_rows",
        )
    )


def start_to_table(result: DataFrame, path: str) -> StreamingQuery:
    """Process what is available, exactly once, into parquet with its own checkpoint."""
    return (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )


def run_available(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """Drive a streaming result to the end of its source and read the sink."""
    path = scratch_path(spark, name)
    schema = result.schema
    start_to_table(result, path).awaitTermination()
    return spark.read.schema(schema).parquet(path)
