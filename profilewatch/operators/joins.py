"""Joins whose left side may hold a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DIGEST = "_join_digest"


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` so that AQE can split a hot key of the left side.

    AQE splits only between two sides that come straight from an exchange. A side
    that was aggregated on the join keys keeps that partitioning and has no
    exchange of its own, and a hot key would then stay in one task. Joining on a
    digest beside the keys gives both sides their own exchange; the right side is
    one row per key, so moving it is cheap. A small right side is still broadcast
    by its size.
    """
    digest = F.xxhash64(*keys)
    return (
        left.withColumn(_DIGEST, digest)
        .join(right.withColumn(_DIGEST, digest), [_DIGEST, *keys], how)
        .drop(_DIGEST)
    )
