"""Reading signal rows, payloads and captures; writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CELL_KEYS, KEEP_DIMS, REFERENCE_SIGNAL, SCALARS
from ..functions.signals import is_pass_text, layer_signal_names, pass_number
from ..functions.text import prompt_text
from ..functions.vectors import leading_dims
from ..operators.cells import first_per_key, latest_per_request
from ..schemas import CAPTURED_ROWS, SIGNALS, conform
from .packs import with_position

Window = tuple[str, str]


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A stored table; the format follows the extension unless given.

    CSV columns are found by their header names in any order and cast strictly to the
    scalar-row contract: the pass stays text, a number that is none fails the
    read. ``id`` and ``deleted_at`` are kept where the file has them; others are left out. ``jdbc``
    takes Spark's own options (``url``, ``partitionColumn`` on the id,
    ``numPartitions``); filters below push down to the database.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt == "csv":
        return _signals_by_name(spark.read.csv(path, header=True, **options))
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=path, **options).load()
    return spark.read.format(fmt).options(**options).load(path)


def _signals_by_name(text: DataFrame) -> DataFrame:
    have = set(text.columns)
    fields = [*SIGNALS.fields, T.StructField("id", T.LongType()), T.StructField("deleted_at", T.TimestampType())]
    optional = {"id", "deleted_at"}
    return text.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
            if f.name in have or f.name not in optional
        ]
    )


def read_capture(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A stored capture with ``id``: its own, or the position of the row in the file.

    Of the copies of a key a comparison keeps the first one in this order.
    """
    rows = read_table(spark, path, fmt)
    if "id" in rows.columns:
        return rows
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    scan = spark.read.csv(path, header=True) if fmt == "csv" else rows
    placed = with_position(scan, [F.col(c) for c in scan.columns], "id")
    return _signals_by_name(placed) if fmt == "csv" else placed


def write_csv(df: DataFrame, path: str) -> None:
    """Score, diff and snapshot tables leave as CSV; quotes are doubled inside text."""
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_captured(df: DataFrame, path: str) -> None:
    conform(df, CAPTURED_ROWS).write.mode("overwrite").parquet(path)


def in_window(ts: Column, window: Window) -> Column:
    """Half-open: the start counts, the end does not."""
    start, end = window
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))


def live_payloads(payloads: DataFrame, window: Window, model_id: str | None = None) -> DataFrame:
    kept = payloads.filter(in_window(F.col("timestamp"), window) & F.col("deleted_at").isNull())
    return kept if model_id is None else kept.filter(F.col("model_id") == model_id)


def signals_in_window(
    signals: DataFrame,
    payloads: DataFrame,
    window: Window,
    *,
    signal_types: Sequence[str] | None = None,
    model_id: str | None = None,
    passes: Sequence[int] | None = None,
) -> DataFrame:
    """Live signal rows of the requests whose *payload* falls in the window.

    Only signal columns leave the join and keys are deduplicated later, so it is
    a semi join: payload duplicates cannot multiply rows, and a small window is
    broadcast by size. The pass filter compares stored text to reach the scan.
    """
    rows = signals.filter(F.col("deleted_at").isNull() & F.col("forward_pass_index").isNotNull())
    if signal_types:
        rows = rows.filter(F.col("signal_type").isin(list(signal_types)))
    if passes:
        rows = rows.filter(F.col("forward_pass_index").isin([str(p) for p in passes]))
    wanted = live_payloads(payloads, window, model_id).select("request_id")
    return rows.join(wanted, "request_id", "left_semi")


def read_signals(
    signals: DataFrame,
    payloads: DataFrame,
    window: Window,
    *,
    signal_types: Sequence[str] | None = None,
    model_id: str | None = None,
    passes: Sequence[int] | None = None,
    tie_break: str = "id",
) -> DataFrame:
    """One scalar row per (request, signal, pass): the lowest id of a double write."""
    rows = signals_in_window(
        signals, payloads, window, signal_types=signal_types, model_id=model_id, passes=passes
    )
    return first_per_key(rows, CELL_KEYS, [*SCALARS, "time"], tie_break)


def layer_signals_in_window(signals, payloads, window, *, model_id=None, passes=None, signal_types=None):
    """What the panel reads: every decoder layer unless the caller narrows it."""
    return signals_in_window(
        signals,
        payloads,
        window,
        signal_types=signal_types or layer_signal_names(),
        model_id=model_id,
        passes=passes,
    )


def read_prompts(
    payloads: DataFrame, window: Window, model_id: str | None = None, ordered: bool = True
) -> DataFrame:
    """Request id, timestamp and prompt text of the live payloads, oldest first."""
    found = live_payloads(payloads, window, model_id).select(
        "request_id", "timestamp", prompt_text(F.col("payload")).alias("prompt")
    )
    return found.orderBy("timestamp") if ordered else found


def read_last_vectors(
    signals: DataFrame,
    payloads: DataFrame,
    window: Window,
    *,
    model_id: str | None = None,
    signal_type: str = REFERENCE_SIGNAL,
    min_pass: int = 2,
    keep_dims: int = KEEP_DIMS,
) -> DataFrame:
    """Per request the vector of its last generated token (numerically highest pass).

    ``min_pass=0`` also admits the prefill.
    """
    number = pass_number(F.col("forward_pass_index"))
    rows = signals_in_window(
        signals, payloads, window, signal_types=[signal_type], model_id=model_id
    ).filter(
        (F.size("embedding_vector") > 0) & is_pass_text(F.col("forward_pass_index")) & (number >= min_pass)
    )
    picked = latest_per_request(
        rows.select(
            "request_id",
            "id",
            "forward_pass_index",
            number.alias("pass"),
            leading_dims(F.col("embedding_vector"), keep_dims).alias("embedding_vector"),
        ),
        ["forward_pass_index", "embedding_vector"],
    )
    return picked
