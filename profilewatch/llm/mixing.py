"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

The mix is ``share`` times as large as all sources together. Each source asks for a
part of it by weight, but for no more than ``cap`` times its own size (its maximum of
epochs); what a clamped source leaves is dealt to the others by weight, again and
again, until none is above its cap.

A source's target over its size is the number of its repetitions. Every document is
taken as often as the whole part says. The fraction is filled with whole documents
in the order of a seeded hash as long as they fit, and with the one document further
on that comes closest to the gap that is left. The hash values of these two ends are all
that is kept of a source: applying a mix to documents is a lookup by source.

How it scales: sizes are computed once and settled as a narrow table. To find where a
source stops, sizes are summed by (source, hash prefix) with map-side combine; only
the documents of the one prefix in which the target falls are ordered. So a source
that holds a third of all rows is ordered in one 4096th of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from . import kernels as K

SHARE = 1.5
CAP = 2.0
#: Hexadecimal digits of the seeded hash by which sizes are summed first.
PREFIX = 3
#: Sources up to here are sent to every task; above, they are joined.
BROADCAST_SOURCES = 100_000

_MEASURED = "doc_id long, source string, size long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(2)
        _, offs = K.text_bytes(text)
        sizes = []
        for lo, hi in K.steps(offs, 8 * K.STEP_BYTES):
            _, _, first = K.word_spans(*K.text_bytes(text.slice(lo, hi - lo)))
            sizes.append(np.diff(first))
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.string()), pa.array(size, pa.int64())],
            names=["doc_id", "source", "size"],
        )


def measured(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, source, size``: the number of words of every row."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(_measure, _MEASURED)


def _draw(doc_id: Column, seed: int) -> Column:
    """A row's place in the seeded order."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed))))


def source_sizes(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size"))


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Sources by code point, null last, with weights that repeat. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (place % len(cycle) + 1).cast("int"))
    return sources.withColumn("weight", weight.cast("long"))


def water_fill(weighted: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of sources with ``source_size`` and ``weight``.

    Only sums reach the driver: of weights and sizes of the sources not clamped yet.
    Sizes and weights are whole numbers, so their sums do not depend on their order.
    A source of weight 0 or size 0 gets the target 0.
    """
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    clamped = F.lit(False)
    level = F.lit(0.0)
    known = -1
    while True:
        row = weighted.agg(
            F.count_if(clamped).alias("n"),
            F.sum(F.when(clamped, F.col("source_size"))).alias("held"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] == known:
            break
        known = row["n"]
        rest = share * total - cap * (row["held"] or 0)
        level = F.lit(max(0.0, rest) / row["weight"] if row["weight"] else float("inf"))
        clamped = F.coalesce(level * F.col("weight") > cap * F.col("source_size"), F.lit(False))
    target = F.when(F.col("weight") == 0, F.lit(0.0)).when(
        clamped, cap * F.col("source_size")
    ).otherwise(level * F.col("weight"))
    return weighted.withColumn("target", target)


def plan_mix(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Per source: ``source, source_size, target, whole, stop, filler``.

    A document is taken ``whole`` times, and once more if its draw is not above
    ``stop`` or is the ``filler`` (null: never). ``sizes`` is read several times and
    should be settled.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    need = F.col("target") - whole * F.col("source_size")
    plan = targets.select("source", "source_size", "target", whole.alias("whole"), need.alias("need"))
    drawn = sizes.select("source", "size", _draw(F.col("doc_id"), seed).alias("draw"))
    by_prefix = drawn.groupBy("source", F.substring("draw", 1, PREFIX).alias("prefix")).agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_prefix.select("source", "prefix", "size", F.sum("size").over(running).alias("upto"))
    falls = (
        _same_source(ends, plan)
        .filter((F.col("upto") - F.col("size") < F.col("need")) & (F.col("upto") >= F.col("need")))
        .select("source", "prefix", "need", (F.col("upto") - F.col("size")).alias("before"))
    )
    inside = _same_source(drawn, falls).filter(F.substring("draw", 1, PREFIX) == F.col("prefix"))
    order = Window.partitionBy("source").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)
    placed = inside.select("source", "prefix", "draw", "need", "before", (F.col("before") + F.sum("size").over(order)).alias("upto"))
    # the last draw that stays within the need, or everything below the prefix
    fits = F.when(F.col("upto") <= F.col("need"), F.struct("draw", "upto"))
    stops = placed.groupBy("source", "prefix", "need", "before").agg(F.max(fits).alias("last"))
    stops = stops.select(
        "source",
        F.coalesce("last.draw", "prefix").alias("stop"),
        (F.col("need") - F.coalesce("last.upto", "before")).alias("gap"),
    )
    stops = settle(stops)
    left = _same_source(drawn, stops).filter((F.col("draw") > F.col("stop")) & (F.col("size") < 2 * F.col("gap")))
    miss = F.struct(F.abs(F.col("gap") - F.col("size")), F.col("draw"))
    fillers = left.filter("size > 0").groupBy("source").agg(F.min_by("draw", miss).alias("filler"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    joined = plan.withColumn("k", key).join(stops.withColumn("k", key).drop("source", "gap"), "k", "left")
    joined = joined.join(fillers.withColumn("k", key).drop("source"), "k", "left")
    wanted = F.col("need") > 0
    return joined.select(
        "source", "source_size", "target", "whole",
        F.when(wanted, F.col("stop")).alias("stop"), F.when(wanted, F.col("filler")).alias("filler"),
    )


def _same_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns; a missing source is a source too."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    right = sources.withColumn("__k", key).drop("source")
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.withColumn("__k", key).join(right, "__k").drop("__k")


def with_repeats(rows: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """Rows that have ``doc_id, source`` with ``source_size, target, repeats``."""
    draw = _draw(F.col("doc_id"), seed)
    extra = F.coalesce(draw <= F.col("stop"), F.lit(False)) | F.coalesce(draw == F.col("filler"), F.lit(False))
    return (
        _same_source(rows, plan)
        .withColumn("repeats", F.col("whole") + extra.cast("long"))
        .drop("whole", "stop", "filler")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: DataFrame | None = None,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents with their repetitions, and the plan by source.

    The first frame has ``doc_id, source, size, source_size, target, repeats, taken``,
    one row per input row; the second is what ``with_repeats`` applies to whole
    documents. ``weights`` holds ``source, weight`` (absent sources weigh 0); without it the
    sources weigh 3, 1, 2 in turn. A null or empty text has size 0 and is taken like any
    other. A null source is a source of its own, ordered last. Rows that share an id
    share their draw and are taken together. An empty table gives empty frames.
    """
    sizes = settle(measured(docs, id_col, source_col, text_col))
    sources = source_sizes(sizes)
    if weights is None:
        weighted = cycled_weights(sources)
    else:
        given = weights.select("source", F.col("weight").cast("long").alias("weight"))
        key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
        given = given.withColumn("k", key).groupBy("k").agg(F.sum("weight").alias("weight"))
        weighted = sources.withColumn("k", key).join(given, "k", "left").drop("k").fillna({"weight": 0})
    targets = water_fill(settle(weighted), share, cap)
    plan = settle(plan_mix(sizes, targets, seed))
    taken = with_repeats(sizes, plan, seed).withColumn("taken", F.col("size") * F.col("repeats"))
    return taken, plan


def repeated(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The documents themselves, each as often as the plan takes it; columns unchanged."""
    names = docs.columns
    held = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"),
    )
    drawn = with_repeats(held, plan, seed).filter("repeats > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")
