"""Gaussian manifold over embedding vectors and its out-of-distribution score.

The training covariance is handled through its eigenbasis, which MLlib's PCA
computes from a distributed Gramian (dimensions x dimensions on the driver, never
rows). In that basis shrinkage and inversion are per axis, so scoring is one
matrix-vector product and one weighted norm, both in the JVM.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    MANIFOLD_PCA_K,
    MANIFOLD_QUANTILE,
    MANIFOLD_SHRINKAGE,
    MANIFOLD_SMALL_SAMPLE_SHRINKAGE,
    OOD_PROB_MAX,
)
from ..functions.distributions import chi_square_cdf
from ..functions.vectors import scaled_norm
from ..session import settle
from .quantiles import exact_quantiles

#: "pca": reduced space. "full": whole space, full quadratic form. "diagonal":
#: whole space, only the diagonal of the inverse covariance.
MODES = ("pca", "full", "diagonal")


@dataclass
class Manifold:
    mode: str
    dim: int
    k: int
    shrinkage: float
    quantile: float
    threshold: float
    mean: list[float]
    weights: list[float]
    basis: PCAModel | None
    n_train: int = 0
    #: Distances of the training vectors by quantile.
    spread: dict[float, float] = field(default_factory=dict)

    def distances(self, df: DataFrame, vector: str = "vector", out: str = "dist") -> DataFrame:
        """Mahalanobis distance of every row; NULL for a missing vector."""
        checked = F.when(F.size(vector) == self.dim, F.col(vector)).when(
            F.col(vector).isNotNull(),
            F.raise_error(F.lit(f"vector does not have {self.dim} dimensions")).cast("array<double>"),
        )
        x = checked.cast("array<double>")
        if self.mode == "diagonal":
            centred = F.zip_with(x, _literal(self.mean), lambda a, m: a - m)
            return df.withColumn(out, scaled_norm(centred, _literal(self.weights)))
        # MLlib's projection does not centre; the projected mean is subtracted
        # afterwards, on k numbers instead of on every dimension
        offset = np.asarray(self.basis.pc.toArray()).T @ np.asarray(self.mean)
        present = F.coalesce(x, _literal([0.0] * self.dim))
        projected = self.basis.setInputCol("_x").setOutputCol("_z").transform(
            df.withColumn("_x", array_to_vector(present))
        )
        centred = F.zip_with(vector_to_array("_z"), _literal(offset), lambda z, m: z - m)
        dist = F.when(F.col(vector).isNotNull(), scaled_norm(centred, _literal(self.weights)))
        return projected.withColumn(out, dist).drop("_x", "_z")

    def score(
        self, df: DataFrame, vector: str = "vector", ood_prob_max: float = OOD_PROB_MAX
    ) -> DataFrame:
        """Adds ``ood_dist``, ``ood_prob`` and the verdict ``is_ood``."""
        scored = self.distances(df, vector, "ood_dist").withColumn(
            "ood_prob", chi_square_cdf(F.col("ood_dist") * F.col("ood_dist"), self.k)
        )
        return scored.withColumn(
            "is_ood",
            ood_verdict(F.col("ood_dist"), F.col("ood_prob"), self.threshold, ood_prob_max),
        )

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        row = [
            (
                self.mode, self.dim, self.k, self.shrinkage, self.quantile, self.threshold,
                self.mean, self.weights, self.n_train, self.spread,
            )
        ]
        spark.createDataFrame(row, _SAVED).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/manifold"
        )
        if self.basis is not None:
            self.basis.write().overwrite().save(f"{path}/basis")


_SAVED = (
    "mode string, dim int, k int, shrinkage double, quantile double, threshold double, "
    "mean array<double>, weights array<double>, n_train long, spread map<double,double>"
)


def load_manifold(spark: SparkSession, path: str) -> Manifold:
    saved = spark.read.parquet(f"{path}/manifold").first().asDict()
    basis = None if saved["mode"] == "diagonal" else PCAModel.load(f"{path}/basis")
    return Manifold(basis=basis, **saved)


def _literal(values) -> Column:
    """A constant array; the optimizer folds the parse, so wide ones stay one expression."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def ood_verdict(
    dist: Column, prob: Column, threshold: float, ood_prob_max: float = OOD_PROB_MAX
) -> Column:
    """Beyond the training quantile, or less likely than the gate tolerates."""
    return (dist > F.lit(threshold)) | (prob > F.lit(ood_prob_max))


def safe_k(n: int, dim: int, pca_k: int) -> int:
    return min(pca_k, dim, max(n - 2, 2))


def safe_shrinkage(n: int, k: int, shrinkage: float) -> float:
    return shrinkage if n > 2 * k else max(shrinkage, MANIFOLD_SMALL_SAMPLE_SHRINKAGE)


def fit_manifold(
    vectors: DataFrame,
    vector: str = "vector",
    *,
    mode: str = "pca",
    pca_k: int = MANIFOLD_PCA_K,
    shrinkage: float = MANIFOLD_SHRINKAGE,
    quantile: float = MANIFOLD_QUANTILE,
) -> Manifold:
    """Fit mean, shrunk precision and the distance threshold on training vectors.

    The vectors are settled once because four jobs read them; the jobs return
    counts, one mean vector, the eigenbasis and four quantiles.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, choose from {MODES}")
    if not 0.0 < quantile < 1.0:
        raise ValueError(f"the threshold quantile {quantile} is not between 0 and 1")
    train = settle(
        vectors.filter(F.size(vector) > 0).select(
            F.col(vector).cast("array<double>").alias("vector")
        )
    ).withColumn("_x", array_to_vector("vector"))
    head = train.select(
        F.count(F.lit(1)).alias("n"),
        Summarizer.metrics("mean", "variance").summary(F.col("_x")).alias("s"),
    ).first()
    n = head["n"]
    if n < 2:
        raise ValueError(f"{n} training vectors; at least 2 are needed for a covariance")
    mean, variance = head["s"]["mean"].toArray(), head["s"]["variance"].toArray()
    dim = len(mean)

    k = dim
    if mode == "pca":
        k = safe_k(n, dim, pca_k)
        if n < k + 2:
            raise ValueError(f"{n} training vectors are too few samples for {k} dimensions")
        shrinkage = safe_shrinkage(n, k, shrinkage)
    basis = PCA(k=k, inputCol="_x", outputCol="_z").fit(train)

    # explained variance is a share; the trace turns it back into eigenvalues
    eigen = np.asarray(basis.explainedVariance) * float(variance.sum())
    shrunk = (1.0 - shrinkage) * eigen + shrinkage * eigen.mean()
    if not (shrunk > 0.0).all():
        raise ValueError("the training vectors do not vary, so no distance can be scaled by their spread")
    precision = 1.0 / shrunk
    weights = precision
    if mode == "diagonal":
        weights = (np.asarray(basis.pc.toArray()) ** 2) @ precision

    model = Manifold(
        mode=mode, dim=dim, k=k, shrinkage=float(shrinkage), quantile=quantile,
        threshold=float("inf"), mean=mean.tolist(), weights=weights.tolist(),
        basis=None if mode == "diagonal" else basis,
    )
    dist = model.distances(train.drop("_x")).select("dist")
    threshold, p50, p95, p99 = exact_quantiles(dist, "dist", [quantile, 0.50, 0.95, 0.99])
    model.threshold = float(threshold)
    model.n_train = n
    model.spread = {0.5: float(p50), 0.95: float(p95), 0.99: float(p99)}
    return model
