"""Detectors from outside: any function over a matrix of vectors takes the manifold's place in the gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import OOD_PROB_MAX
from ..session import settle

VERDICT = "dist double, ood_prob double, is_ood boolean"
#: Partial states that one task unites.
_FAN_IN = 64

Predict = Callable[[np.ndarray], Mapping[str, np.ndarray]]


@dataclass(frozen=True)
class Detector:
    """Scores vectors with ``predict``: a matrix in, arrays ``dist, ood_prob, is_ood`` out, one entry per row.

    Runs on Arrow batches inside the tasks. ``score`` is what ``textgate.run_gate`` asks of a
    detector, so it goes where a ``Manifold`` goes.
    """

    predict: Predict
    dim: int

    def score(self, df: DataFrame, vector: str = "vector", ood_prob_max: float = OOD_PROB_MAX) -> DataFrame:
        """Adds ``ood_dist, ood_prob, is_ood``; a missing vector is not judged, one of another length fails the job."""
        checked = F.when(F.size(vector) == self.dim, F.col(vector)).when(
            F.col(vector).isNotNull(),
            F.raise_error(F.lit(f"vector does not have {self.dim} dimensions")).cast("array<double>"),
        )
        verdict = _arrow(self.predict)(checked.cast("array<double>"))
        judged = df.withColumn("_verdict", verdict)
        found = F.col("_verdict.is_ood") | (F.col("_verdict.ood_prob") > F.lit(ood_prob_max))
        return judged.withColumns(
            {"ood_dist": F.col("_verdict.dist"), "ood_prob": F.col("_verdict.ood_prob"), "is_ood": found}
        ).drop("_verdict")


def _arrow(predict: Predict):
    def batch(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"dist": np.nan, "ood_prob": np.nan, "is_ood": None}, index=vectors.index, dtype=object)
        present = vectors.notna()
        if present.any():
            said = predict(np.stack(vectors[present].to_numpy()).astype(np.float64))
            out.loc[present, "dist"] = np.asarray(said["dist"], dtype=np.float64).ravel()
            out.loc[present, "ood_prob"] = np.asarray(said["ood_prob"], dtype=np.float64).ravel()
            out.loc[present, "is_ood"] = np.asarray(said["is_ood"]).ravel().astype(bool)
        missing = ~present
        out.loc[missing, ["dist", "ood_prob"]] = None
        return out

    return F.pandas_udf(batch, VERDICT)


def fit_parts(
    vectors: DataFrame,
    part: Callable[[np.ndarray], np.ndarray],
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray],
    vector: str = "vector",
) -> np.ndarray | None:
    """What a detector learns, from mergeable states: ``part`` of each batch, ``merge`` of any two.

    A state is a row of numbers of fixed length. Tasks fold their batches, then some dozens of states
    meet in a task until one is left; the driver sees that one only. No vector gives None.
    """
    def fold(states: list[np.ndarray]) -> np.ndarray:
        total = states[0]
        for s in states[1:]:
            total = merge(total, s)
        return total

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            rows = b.column(0).drop_null().to_pylist()
            if rows:
                found = np.asarray(part(np.asarray(rows, dtype=np.float64)), dtype=np.float64)
                state = found if state is None else merge(state, found)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": [state.tolist()]})

    def united(table: pa.Table) -> pa.Table:
        total = fold([np.asarray(s) for s in table.column("state").to_pylist()])
        return pa.table({"state": [total.tolist()]})

    states = settle(vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(first, "state array<double>"))
    count = states.count()
    while count > 1:
        place = F.spark_partition_id() % F.lit(max(1, -(-count // _FAN_IN)))
        states = settle(states.groupBy(place.alias("g")).applyInArrow(united, "state array<double>"))
        count = states.count()
    row = states.first()
    return None if row is None else np.asarray(row["state"])


_REGISTERED: dict[str, Callable[..., Any]] = {}


def register(name: str, make: Callable[..., Any]) -> None:
    """Name a function that makes a detector, from training vectors or from nothing."""
    _REGISTERED[name] = make


def detector(name: str, *args, **kwargs):
    """The detector registered under ``name``, made with the arguments."""
    if name not in _REGISTERED:
        raise KeyError(f"no detector {name!r}; there are {sorted(_REGISTERED)}")
    return _REGISTERED[name](*args, **kwargs)


def widest_axis(vectors: DataFrame, dim: int, limit: float = 3.0, vector: str = "vector") -> Detector:
    """A plain detector of this kind: the largest z over the axes, normal beyond ``limit`` standard deviations."""
    def part(x: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))

    state = fit_parts(vectors, part, np.add, vector)
    if state is None or state[0] < 2:
        raise ValueError("need at least two vectors")
    n, total, squares = state[0], state[1 : 1 + dim], state[1 + dim :]
    mean = total / n
    sd = np.sqrt(np.maximum(squares - n * mean * mean, 0.0) / (n - 1))

    def predict(z: np.ndarray) -> dict[str, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(sd > 0, np.abs(z - mean) / sd, 0.0).max(axis=1)
        return {"dist": far, "ood_prob": 1 - np.exp(-far * far / 2), "is_ood": far > limit}

    return Detector(predict, dim)


register("widest_axis", widest_axis)
