"""Per-request layer profiles and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FLAT_Z_CV_MAX, METRIC_LAYERS, METRIC_PASSES, MIN_PASSES
from ..functions.numeric import correlation, finite, guarded_z, is_finite, slope, variation

STATISTICS = [
    "cv", "slope", "corr", "z_cv", "z_slope", "max_abs_z_layer", "cv_pass_slope",
]


_BAND_SCALARS = ["cv_mean", "cv_sd", "slope_mean", "slope_sd"]


def _on(axis: str, value: Column) -> Column:
    return F.when(F.col("axis") == axis, value)


def axis_entries(cells: DataFrame, *kept: str) -> DataFrame:
    """Each cell once for its layer and once for its pass, so that one grouping gives both marginals."""
    return cells.select(
        *kept,
        "request_id",
        F.explode(
            F.array(
                F.struct(F.lit("layer").alias("axis"), F.col("layer").alias("at"), F.col("value")),
                F.struct(F.lit("pass").alias("axis"), F.col("pass").alias("at"), F.col("value")),
            )
        ).alias("m"),
    ).select(*kept, "request_id", "m.*")


def axis_aggregates() -> list[Column]:
    """Mean over passes of a layer, spread over layers of a pass, and how many cells stand behind them."""
    return [
        F.avg("value").alias("mean"),
        variation(F.col("value")).alias("cv"),
        F.count("value").alias("n_values"),
        F.count(F.lit(1)).alias("n_cells"),
    ]


def axis_means(cells: DataFrame) -> DataFrame:
    """Both marginals of the (pass, layer) grid in one aggregation.

    Cells are at most layers x passes per request, hence ``repartition`` by
    request is even; both groupings below it then need no further exchange.
    """
    marginals = axis_entries(cells.repartition("request_id"))
    return marginals.groupBy("request_id", "axis", "at").agg(*axis_aggregates())


def request_measures(passes: Sequence[int], banded: bool) -> list[Column]:
    """Aggregates over the marginals of one request: the statistics without their guards.

    They are counts, means and co-moments, so a stream keeps them as state of fixed size.
    With a band its ``band_mean, band_sd`` stand beside the rows of the layer axis.
    """
    has_value = F.col("n_values") > 0
    v = _on("layer", F.when(has_value, F.col("mean")))
    position = F.array_position(F.array(*[F.lit(p) for p in passes]), F.col("at")) - 1
    pass_cv = _on("pass", F.when(has_value, F.col("cv")))
    measures = [
        F.count_if((F.col("axis") == "pass") & F.col("at").isNotNull() & has_value).alias(
            "n_passes_used"
        ),
        F.coalesce(F.sum(_on("layer", F.when(F.col("at").isNotNull(), F.col("n_cells")))), F.lit(0))
        .cast("long")
        .alias("n_cells"),
        variation(v).alias("cv"),
        slope(v, F.col("at")).alias("slope"),
        slope(pass_cv, position).alias("cv_pass_slope"),
    ]
    if banded:
        measures += [
            correlation(v, _on("layer", F.col("band_mean"))).alias("corr"),
            F.coalesce(F.max(F.abs(finite(_layer_z(v)))), F.lit(0.0)).alias("max_abs_z_layer"),
        ]
    return measures


def _layer_z(v: Column) -> Column:
    wide = is_finite(F.col("band_sd")) & (F.col("band_sd") > 0)
    return F.when(wide, F.try_divide(v - F.col("band_mean"), F.col("band_sd"))).otherwise(
        _on("layer", F.lit(0.0))
    )


def layer_profiles(cells: DataFrame, min_passes: int = MIN_PASSES) -> DataFrame:
    """``request_id, layer, v``: mean over passes, for requests with enough passes.

    The cells fold once to both marginals; the usable passes of a request, at most the
    passes of the scope, are counted beside its layers in the same partition.
    """
    usable = (F.col("axis") == "pass") & F.col("at").isNotNull() & (F.col("n_values") > 0)
    counted = axis_means(cells).withColumn("_n", F.count_if(usable).over(Window.partitionBy("request_id")))
    wanted = (F.col("axis") == "layer") & F.col("at").isNotNull() & F.col("mean").isNotNull()
    return counted.filter(wanted & (F.col("_n") >= min_passes)).select(
        "request_id", F.col("at").alias("layer"), F.col("mean").alias("v")
    )


def variation_by_pass(cells: DataFrame) -> DataFrame:
    """Cross-layer variation of every pass that carries data."""
    return (
        cells.filter(F.col("pass").isNotNull() & F.col("value").isNotNull())
        .groupBy("request_id", "pass")
        .agg(variation(F.col("value")).alias("cv"))
    )


def request_statistics(
    cells: DataFrame,
    band=None,
    *,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
    min_passes: int = MIN_PASSES,
    arrays: bool = False,
) -> DataFrame:
    """One row per request that was read; metrics are NULL below ``min_passes``.

    With a band the z-scores and the correlation with the healthy shape are
    added; with ``arrays`` also ``profile``, ``z_by_layer`` and ``cv_by_pass``,
    positioned by the ``layers`` and ``passes`` arguments.
    """
    means = axis_means(cells)
    if band is not None:
        # the band is read here once; its scalars ride along to the request row
        ref = band.row()
        at = F.array_position(F.col("_band.layers"), F.col("at").cast("int")).cast("int")
        healthy = F.when((F.col("axis") == "layer") & (at > 0), at)
        means = means.withColumn("_band", ref).select(
            *means.columns,
            F.get(F.col("_band.profile_mean"), healthy - 1).alias("band_mean"),
            F.get(F.col("_band.profile_sd"), healthy - 1).alias("band_sd"),
            *[F.col(f"_band.{c}").alias(f"_{c}") for c in _BAND_SCALARS],
        )

    measures = request_measures(passes, band is not None)
    if band is not None:
        measures += [F.max(f"_{c}").alias(f"_{c}") for c in _BAND_SCALARS]
    has_value = F.col("n_values") > 0
    if arrays:
        def laid_out(axis, wanted, value):
            return F.array(
                *[F.max(F.when((F.col("axis") == axis) & (F.col("at") == k), value)) for k in wanted]
            )

        measures.append(laid_out("layer", layers, F.when(has_value, F.col("mean"))).alias("profile"))
        measures.append(laid_out("pass", passes, F.when(has_value, F.col("cv"))).alias("cv_by_pass"))
        if band is not None:
            measures.append(laid_out("layer", layers, _layer_z(_on("layer", F.when(has_value, F.col("mean"))))).alias("z_by_layer"))

    stats = means.groupBy("request_id").agg(*measures)
    if band is not None:
        stats = stats.withColumns(
            {
                "z_cv": guarded_z(F.col("cv"), F.col("_cv_mean"), F.col("_cv_sd")),
                "z_slope": guarded_z(F.col("slope"), F.col("_slope_mean"), F.col("_slope_sd")),
            }
        ).drop(*[f"_{c}" for c in _BAND_SCALARS])
    enough = F.col("n_passes_used") >= min_passes
    kept = ["request_id", "n_passes_used", "n_cells"]
    return stats.select(
        *kept, *[F.when(enough, F.col(c)).alias(c) for c in stats.columns if c not in kept]
    )


def is_flattened(z_cv: Column, z_cv_max: float = FLAT_Z_CV_MAX) -> Column:
    """The across-layer spread has collapsed; the threshold itself counts."""
    return z_cv <= F.lit(z_cv_max)


def layer_z_scores(cells: DataFrame, band, min_passes: int = MIN_PASSES) -> DataFrame:
    """Long form of the per-layer z: ``request_id, layer, v, z``."""
    wide = is_finite(F.col("profile_sd")) & (F.col("profile_sd") > 0)
    return layer_profiles(cells, min_passes).join(F.broadcast(band.layer()), "layer").select(
        "request_id",
        "layer",
        "v",
        F.when(wide, F.try_divide(F.col("v") - F.col("profile_mean"), F.col("profile_sd")))
        .otherwise(F.lit(0.0))
        .alias("z"),
    )
