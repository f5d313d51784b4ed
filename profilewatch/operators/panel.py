"""The monitoring panel: request scores, window summary, score histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FLAT_Z_CV_MAX, METRIC_LAYERS, METRIC_PASSES, MIN_PASSES, SCORE_BANDS
from ..functions.numeric import equal_width_edges
from .band import Band
from .joins import join_hot
from .profile import is_flattened, request_statistics


def read_request_scores(
    cells: DataFrame,
    band: Band,
    *,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
    z_cv_max: float = FLAT_Z_CV_MAX,
    min_passes: int = MIN_PASSES,
) -> DataFrame:
    """Every request that was read, scored or marked ``incomplete``."""
    stats = request_statistics(cells, band, layers=layers, passes=passes, min_passes=min_passes)
    return stats.select(
        "request_id", "cv", "z_cv", "corr", "slope", "max_abs_z_layer", "cv_pass_slope",
        "n_passes_used",
        is_flattened(F.col("z_cv"), z_cv_max).alias("is_flattened"),
        (F.col("n_passes_used") < min_passes).alias("incomplete"),
    )


def scored_only(scores: DataFrame) -> DataFrame:
    return scores.filter(~F.col("incomplete")).drop("incomplete")


def window_summary(scores: DataFrame, band: Band) -> DataFrame:
    """One row, also for an empty window, which still carries the band."""
    scored = ~F.col("incomplete")
    flat = F.when(scored, F.col("is_flattened").cast("double"))

    def mean_of(name):
        return F.coalesce(F.avg(F.when(scored, F.col(name))), F.lit(0.0))

    totals = scores.agg(
        F.coalesce(F.avg(flat), F.lit(0.0)).alias("flattened_rate"),
        F.count_if(scored).alias("sample_count"),
        mean_of("cv").alias("mean_cv"),
        mean_of("z_cv").alias("mean_z_cv"),
        mean_of("corr").alias("mean_corr"),
        F.count_if(F.col("incomplete")).alias("n_incomplete"),
    ).withColumn("_band", band.row())
    return totals.select(
        "flattened_rate",
        (F.lit(1.0) - F.col("flattened_rate")).alias("healthy_rate"),
        "sample_count",
        "mean_cv",
        "mean_z_cv",
        "mean_corr",
        F.col("_band.cv_mean").alias("reference_cv_mean"),
        F.col("_band.cv_sd").alias("reference_cv_sd"),
        F.col("_band.n_requests").alias("reference_n_requests"),
        "n_incomplete",
    )


def score_distribution(
    scores: DataFrame, column: str = "z_cv", n_bands: int = SCORE_BANDS
) -> DataFrame:
    """Equal-width histogram over the observed range, empty bands included.

    Bands are half open, the last is closed. Equal scores give one band, no
    scores give none. Each score finds its band by comparing with the n + 1
    edges, which come from a one-row aggregate; there is no range join.
    """
    values = scored_only(scores).select(F.col(column).alias("x"))
    frame = values.agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")
    ).filter(F.col("n") > 0)
    single = F.col("lo") == F.col("hi")
    edges = F.when(single, F.array("lo", "hi")).otherwise(
        equal_width_edges(F.col("lo"), F.col("hi"), n_bands)
    )
    frame = frame.select("n", edges.alias("edges"))
    looked_up = values.withColumn("edges", frame.select("edges").scalar())
    at = F.least(
        F.size(F.filter("edges", lambda e: e <= F.col("x"))), F.size("edges") - 1
    )
    counts = looked_up.groupBy(at.alias("band")).agg(F.count(F.lit(1)).alias("count"))
    bands = frame.select(
        "n", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("band")
    )
    return bands.join(counts, "band", "left").select(
        F.col("band").cast("long").alias("band"),
        F.element_at("edges", F.col("band")).alias("lower"),
        F.element_at("edges", F.col("band") + 1).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / F.col("n")).alias("fraction"),
    )


def distribution_by(
    scores: DataFrame, by: str, column: str = "z_cv", n_bands: int = SCORE_BANDS
) -> DataFrame:
    """A histogram per value of ``by``, with the edges and rules of :func:`score_distribution`.

    Missing scores do not count. Ranges are one row per value and ride to the scores in a
    join that Spark may split, so one value may hold most of the rows.
    """
    values = scores.filter(F.col(column).isNotNull()).select(by, F.col(column).alias("x"))
    ranges = values.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    single = F.col("lo") == F.col("hi")
    edges = F.when(single, F.array("lo", "hi")).otherwise(equal_width_edges(F.col("lo"), F.col("hi"), n_bands))
    ranges = ranges.select(by, "n", edges.alias("edges"))
    at = F.least(F.size(F.filter("edges", lambda e: e <= F.col("x"))), F.size("edges") - 1)
    counts = join_hot(values, ranges, [by]).groupBy(by, at.alias("band")).agg(F.count(F.lit(1)).alias("count"))
    bands = ranges.select(by, "n", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("band"))
    return bands.join(counts, [by, "band"], "left").select(
        by,
        F.col("band").cast("long").alias("band"),
        F.element_at("edges", F.col("band")).alias("lower"),
        F.element_at("edges", F.col("band") + 1).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / F.col("n")).alias("fraction"),
    )
