"""Reading a growing table again and again: only what is new, late rows included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CELL_KEYS, SCALARS
from ..operators.cells import first_per_key
from ..operators.joins import join_hot
from .packs import path_exists

_ORDER = "_order"


def _committed(spark: SparkSession, store: str) -> list:
    """Number and mark of every finished poll; a row per poll."""
    return spark.read.parquet(f"{store}/marks").select("poll", "mark").collect() if path_exists(spark, f"{store}/marks") else []


def poll(
    rows: DataFrame,
    store: str,
    *,
    mark: str = "time",
    overlap: Column | None = None,
    keys: Sequence[str] = CELL_KEYS,
    values: Sequence[str] = (*SCALARS, "time"),
    tie_break: str = "id",
) -> DataFrame:
    """Read what ``rows`` has gained since the last poll, keep it in ``store``, return all that is kept.

    The highest ``mark`` seen is stored. The next poll filters ``mark >= highest - overlap``, which
    reaches the scan (or the database), so rows that arrive late by up to ``overlap`` are found; an interval
    for times, a number for ids, nothing for none. Rows without a mark are always read.
    Of the copies of a key the lowest ``tie_break`` counts, over all polls, so polling a
    growing table gives what one full read of it gives. Rows that vanish from the table stay kept.

    A poll writes its rows first and its mark last. One that died before has no mark: its number and
    folder are used again. ``store`` is a folder all executors can reach.
    """
    spark = rows.sparkSession
    done = _committed(spark, store)
    number = 1 + max((r["poll"] for r in done), default=0)
    marks = [r["mark"] for r in done if r["mark"] is not None]
    if marks:
        since = F.lit(max(marks)) if overlap is None else F.lit(max(marks)) - overlap
        rows = rows.filter((F.col(mark) >= since) | F.col(mark).isNull())
    columns = list(dict.fromkeys([*values, mark]))
    fresh = first_per_key(rows.withColumn(_ORDER, F.col(tie_break)), keys, [*columns, _ORDER], tie_break)
    if done:  # rows of the overlap that are kept already
        kept = _kept(spark, store, done).select(*keys, _ORDER)
        fresh = join_hot(fresh, kept.distinct(), [*keys, _ORDER], "left_anti")
    fresh.write.mode("overwrite").parquet(f"{store}/rows/poll={number}")
    landed = spark.read.schema(fresh.schema).parquet(f"{store}/rows/poll={number}")
    landed.agg(F.max(mark).alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{store}/marks/poll={number}")
    return polled(spark, store, keys=keys, values=columns)


def _kept(spark: SparkSession, store: str, done: list) -> DataFrame:
    return spark.read.parquet(*[f"{store}/rows/poll={r['poll']}" for r in done])


def polled(
    spark: SparkSession, store: str, *, keys: Sequence[str] = CELL_KEYS, values: Sequence[str] = (*SCALARS, "time")
) -> DataFrame:
    """All rows of the finished polls, one per key."""
    return first_per_key(_kept(spark, store, _committed(spark, store)), keys, values, _ORDER)
