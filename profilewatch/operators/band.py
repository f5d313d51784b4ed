"""The healthy band: what complete requests look like."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BAND_RANGE_SDS, METRIC_LAYERS, METRIC_PASSES, MIN_PASSES
from .profile import request_statistics


@dataclass(frozen=True)
class Band:
    """One row: scalars of the band plus ``layers, profile_mean, profile_sd`` arrays."""

    frame: DataFrame

    def row(self) -> Column:
        """The row as a struct; one subquery per query however often it is used."""
        return self.frame.select(F.struct("*").alias("band")).scalar()

    def layer(self) -> DataFrame:
        zipped = F.arrays_zip("layers", "profile_mean", "profile_sd")
        return self.frame.select(F.explode(zipped).alias("p")).select(
            F.col("p.layers").alias("layer"), "p.profile_mean", "p.profile_sd"
        )

    def range(self, sds: float = BAND_RANGE_SDS) -> DataFrame:
        return self.frame.select(
            "*",
            (F.col("cv_mean") - sds * F.col("cv_sd")).alias("cv_low"),
            (F.col("cv_mean") + sds * F.col("cv_sd")).alias("cv_high"),
        )

    def save(self, path: str) -> None:
        self.frame.coalesce(1).write.mode("overwrite").parquet(path)


def load_band(spark: SparkSession, path: str) -> Band:
    return Band(spark.read.parquet(path))


def complete_requests(
    cells: DataFrame,
    *,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
) -> DataFrame:
    """Requests that have every (layer, pass) cell; cells are unique, so counting suffices."""
    return (
        cells.filter(F.col("layer").isNotNull())
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n_cells"))
        .filter(F.col("n_cells") == len(set(layers)) * len(set(passes)))
        .select("request_id")
    )


def fit_band(
    cells: DataFrame,
    requests: DataFrame | None = None,
    *,
    layers: Sequence[int] = METRIC_LAYERS,
    passes: Sequence[int] = METRIC_PASSES,
    min_passes: int = MIN_PASSES,
    version: str = "v1",
) -> Band:
    """Mean and sample sd of the variation, the slope and every layer.

    Fitted on ``requests`` if given, else on the complete ones. Fewer than two
    requests, or a chosen request with too few passes, fail the job.
    """
    absent = None
    if requests is not None:
        named = requests.select("request_id").distinct()
        absent = named.join(cells, "request_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
        cells = cells.join(named, "request_id", "left_semi")
    members = request_statistics(
        cells, layers=layers, passes=passes, min_passes=min_passes, arrays=True
    )
    if requests is None:
        members = members.filter(F.col("n_cells") == len(set(layers)) * len(set(passes)))

    # cv, slope and every layer become (name, at, x) entries, so one small
    # aggregation fits them all and the members are computed once
    def entry(name, at, x):
        return F.struct(F.lit(name).alias("name"), F.lit(at).alias("at"), x.alias("x"))

    entries = members.select(
        "n_passes_used",
        F.explode(
            F.array(
                entry("cv", 0, F.col("cv")),
                entry("slope", 0, F.col("slope")),
                *[entry("layer", i, F.col("profile")[i]) for i in range(len(layers))],
            )
        ).alias("e"),
    )
    fitted = entries.groupBy("e.name", "e.at").agg(
        F.avg("e.x").alias("mean"),
        F.stddev_samp("e.x").alias("sd"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_passes_used") < min_passes).alias("n_short"),
    )

    def scalar(name, value):
        return F.max(F.when(F.col("name") == name, F.col(value)))

    n = F.coalesce(scalar("cv", "n"), F.lit(0)).cast("long")
    # the guard is a filter: it runs whatever columns a reader picks
    sound = (
        F.when(
            F.col("n_short") > 0, F.raise_error(F.lit(f"need at least {min_passes} passes with data"))
        )
        .when(F.col("n_requests") < 2, F.raise_error(F.lit("need at least 2 requests to fit a band")))
    )
    if absent is not None:
        sound = sound.when(absent.scalar() > 0, F.raise_error(F.lit("a named request has no rows")))
    # one entry per metric layer
    by_layer = F.array_sort(
        F.collect_list(F.when(F.col("name") == "layer", F.struct("at", "mean", "sd")))
    )
    return Band(
        fitted.agg(
            scalar("cv", "mean").alias("cv_mean"),
            scalar("cv", "sd").alias("cv_sd"),
            scalar("slope", "mean").alias("slope_mean"),
            scalar("slope", "sd").alias("slope_sd"),
            n.alias("n_requests"),
            F.coalesce(F.max("n_short"), F.lit(0)).alias("n_short"),
            by_layer.alias("by_layer"),
        )
        .filter(sound.otherwise(F.lit(True)).cast("boolean"))
        .select(
            "cv_mean",
            "cv_sd",
            "slope_mean",
            "slope_sd",
            "n_requests",
            F.lit(version).alias("version"),
            F.array(*[F.lit(k) for k in layers]).alias("layers"),
            F.array(*[F.lit(p) for p in passes]).alias("passes"),
            F.col("by_layer.mean").alias("profile_mean"),
            F.col("by_layer.sd").alias("profile_sd"),
        )
    )
