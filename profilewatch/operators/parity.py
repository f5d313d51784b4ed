"""Row-for-row comparison of two captures of the same requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import (
    CELL_KEYS,
    COMPARE_ATOL,
    COMPARE_PASSES,
    COMPARE_RTOL,
    EMBED_SIGNAL,
    RELATIVE_FLOOR,
    SCALARS,
    TOKEN_MATCH_TOL,
)
from ..functions.numeric import nan_to_null
from ..functions.signals import pass_number
from ..session import settle
from .cells import order_key
from .joins import join_hot

_SIDES = ("local", "platform")


def comparable_columns(rows: DataFrame, request_id: str | None = None, tie_break: str = "id") -> DataFrame:
    """Keys as text, scalars as doubles, missing scalars NULL, anything else dropped.

    ``request_id`` relabels the whole frame. Copies of a key are resolved later, by the
    lowest ``tie_break``: the stored id, or the row's position in its file
    (``readers.read_capture``). A frame without one has no first copy and is refused.
    """
    have = set(rows.columns)
    if tie_break not in have:
        raise ValueError(f"a capture needs a column {tie_break!r} that orders the copies of a key")
    return rows.select(
        (F.lit(request_id) if request_id is not None else F.col("request_id").cast("string")).alias(
            "request_id"
        ),
        F.col("signal_type").cast("string").alias("signal_type"),
        F.col("forward_pass_index").cast("string").alias("forward_pass_index"),
        *[
            (nan_to_null(F.col(c).try_cast("double")) if c in have else F.lit(None).cast("double")).alias(c)
            for c in SCALARS
        ],
        order_key(rows, tie_break).alias("_order"),
    )


def normalised(rows: DataFrame, request_id: str | None = None, tie_break: str = "id") -> DataFrame:
    """The comparable columns with one row per key, the first one."""
    return comparable_columns(rows, request_id, tie_break).groupBy(*CELL_KEYS).agg(
        *[F.min_by(c, "_order").alias(c) for c in SCALARS]
    )


def paired_rows(local: DataFrame, platform: DataFrame, passes: Sequence[int] | None = COMPARE_PASSES) -> DataFrame:
    """Both captures side by side, one row per key that either has.

    A full outer join of two deduplicated sides is one aggregation over their
    union: each row carries its side, the first copy per side wins, and copies of
    a hot key fold before the only shuffle.
    """
    sides = []
    for name, rows in zip(_SIDES, (local, platform)):
        side = comparable_columns(rows)
        if passes is not None:
            side = side.filter(F.col("forward_pass_index").isin([str(p) for p in passes]))
        sides.append(side.withColumn("_side", F.lit(name)))
    union = sides[0].unionByName(sides[1])
    values = [
        F.min_by(F.when(F.col("_side") == name, F.col(c)), F.when(F.col("_side") == name, F.col("_order")))
        .alias(f"{c}_{name}")
        for name in _SIDES
        for c in SCALARS
    ]
    has = {name: F.max(F.col("_side") == name) for name in _SIDES}
    return union.groupBy(*CELL_KEYS).agg(
        *values, has["local"].alias("_local"), has["platform"].alias("_platform")
    )


def _token_flags(pairs: DataFrame, token_match_tol: float) -> DataFrame:
    """Per request: the passes whose fed token differs, judged by the embedding row.

    The embedding is a table lookup, so an equal token agrees to noise; a missing
    side or value counts as different. One row per request, one entry per pass.
    """
    differing = F.when(_differs(token_match_tol), F.col("pass"))
    return pairs.filter(F.col("signal_type") == EMBED_SIGNAL).groupBy("request_id").agg(
        F.collect_set(differing).alias("_differs"),
        F.min(differing).alias("_first_differs"),
        F.lit(True).alias("_printed"),
    )


def _differs(token_match_tol: float) -> Column:
    delta = F.abs(F.col("std_local") - F.col("std_platform"))
    return ~F.coalesce(delta < token_match_tol, F.lit(False))


def _flags() -> dict[str, Column]:
    """Comparability is cumulative: a pass after a differing token never counts again,
    so it is "before the first difference", a minimum over the request."""
    readable = F.col("pass").isNotNull()

    def flag(value, otherwise):
        return F.coalesce(F.when(readable, value), F.lit(otherwise))

    return {
        "token_match": flag(~F.array_contains("_differs", F.col("pass")), True),
        "comparable": flag(F.col("pass") < F.col("_first_differs"), True),
        "has_fingerprint": flag(F.col("_printed"), False),
    }


_HELPERS = ("_differs", "_first_differs", "_printed")


def _numbered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("pass", pass_number(F.col("forward_pass_index")))


def _flags_joined(pairs: DataFrame, token_match_tol: float) -> DataFrame:
    """The pairs with their flags, for captures that lie anywhere.

    The pairs are settled, so each capture is scanned once; the flags, one row per request,
    come back in a join that may split a request with very many rows.
    """
    numbered = settle(_numbered(pairs))
    flags = _token_flags(numbered, token_match_tol)
    return join_hot(numbered, flags, ["request_id"], "left").withColumns(_flags()).drop(*_HELPERS)


def _flags_in_place(pairs: DataFrame, token_match_tol: float) -> DataFrame:
    """The pairs with their flags, for pairs whose requests already lie together: no exchange."""
    request = Window.partitionBy("request_id")
    is_print = F.col("signal_type") == EMBED_SIGNAL
    differing = F.when(is_print & _differs(token_match_tol), F.col("pass"))
    seen = {
        "_differs": F.collect_set(differing).over(request),  # an entry per pass
        "_first_differs": F.min(differing).over(request),
        "_printed": F.max(F.when(is_print, F.lit(True))).over(request),
    }
    return _numbered(pairs).withColumns(seen).withColumns(_flags()).drop(*_HELPERS)


def comparability(pairs: DataFrame, token_match_tol: float = TOKEN_MATCH_TOL) -> DataFrame:
    """``request_id, pass, token_match, comparable, has_fingerprint`` of every readable pass."""
    flagged = _flags_joined(pairs, token_match_tol).filter(F.col("pass").isNotNull())
    return flagged.select("request_id", "pass", "token_match", "comparable", "has_fingerprint").distinct()


def diff_rows(
    local: DataFrame,
    platform: DataFrame,
    *,
    passes: Sequence[int] | None = COMPARE_PASSES,
    columns: Sequence[str] = SCALARS,
    token_match_tol: float = TOKEN_MATCH_TOL,
) -> DataFrame:
    """Outer comparison with deltas, origin and comparability of every row."""
    return _compared(_flags_joined(paired_rows(local, platform, passes), token_match_tol), columns)


def _compared(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    captured = F.col("_local") & F.col("_platform")
    side = (
        F.when(captured, F.lit("both"))
        .when(F.col("_local"), F.lit("local_only"))
        .otherwise(F.lit("platform_only"))
    )
    return flagged.select(
        *CELL_KEYS,
        *[f"{c}_{name}" for name in _SIDES for c in SCALARS],
        *[(F.col(f"{c}_local") - F.col(f"{c}_platform")).alias(f"d_{c}") for c in columns],
        captured.alias("captured"),
        side.alias("side"),
        "pass",
        "token_match",
        (F.col("comparable") & captured).alias("comparable"),
        "has_fingerprint",
    )


#: Rows of a capture in one bucket: a task holds the bucket's rows of both captures.
BUCKET_ROWS = 200_000
LEAST_BUCKETS = 8


def _buckets_of(table: str, rows: DataFrame) -> int:
    """The buckets of a stored table, or as many as a first capture of this size asks for."""
    spark = rows.sparkSession
    if not spark.catalog.tableExists(table):
        return max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    about = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter(F.col("col_name") == "Num Buckets")
    return int(about.first()["data_type"])


def store_capture(rows: DataFrame, table: str, capture: str, path: str, buckets: int | None = None) -> None:
    """Add a capture to a table of captures: a partition of its own, bucketed by request.

    Stored is one row per key, the first copy. ``path`` is the table's folder, shared by all
    executors. The first capture fixes the buckets: by default one for every ``BUCKET_ROWS`` of
    its rows, so that larger captures get more of them; later ones take what the table has.
    A name that is in the table is refused, because appending would double its rows.
    """
    spark = rows.sparkSession
    if spark.catalog.tableExists(table) and not spark.table(table).filter(F.col("capture") == capture).isEmpty():
        raise ValueError(f"{table} already holds a capture {capture!r}")
    buckets = buckets or _buckets_of(table, rows)
    (
        normalised(rows)
        .withColumn("capture", F.lit(capture))
        .repartition(buckets, "request_id")
        .write.partitionBy("capture")
        .bucketBy(buckets, "request_id")
        .sortBy(*CELL_KEYS)
        .mode("append")
        .option("path", path)
        .saveAsTable(table)
    )


def diff_stored(
    spark: SparkSession,
    table: str,
    local: str,
    platform: str,
    *,
    passes: Sequence[int] | None = COMPARE_PASSES,
    columns: Sequence[str] = SCALARS,
    token_match_tol: float = TOKEN_MATCH_TOL,
) -> DataFrame:
    """``diff_rows`` of two captures of a stored table.

    Both are read in one bucketed scan, in which a request lies in one bucket: pairing, flags
    and whatever is grouped by request afterwards need no exchange.
    """
    rows = spark.table(table).filter(F.col("capture").isin([local, platform]))
    if passes is not None:
        rows = rows.filter(F.col("forward_pass_index").isin([str(p) for p in passes]))
    names = dict(zip(_SIDES, (local, platform), strict=True))
    pairs = rows.groupBy(*CELL_KEYS).agg(
        *[
            F.max(F.when(F.col("capture") == name, F.col(c))).alias(f"{c}_{side}")  # one row per key and capture
            for side, name in names.items()
            for c in SCALARS
        ],
        *[F.max(F.col("capture") == name).alias(f"_{side}") for side, name in names.items()],
    )
    return _compared(_flags_in_place(pairs, token_match_tol), columns)


def sorted_diff(diff: DataFrame) -> DataFrame:
    """Report order: by key text, so pass '10' sorts before '2'."""
    return diff.orderBy(*CELL_KEYS)


def within_tolerance(delta: Column, platform: Column, atol: float, rtol: float) -> Column:
    return F.abs(delta) <= F.lit(atol) + F.lit(rtol) * F.abs(platform)


def _by_request_pass(diff: DataFrame, column: str, atol: float, rtol: float) -> DataFrame:
    """Everything the summaries need, folded to (request, pass) first.

    Distinct request counts then become plain sums over requests, instead of the
    row expansion that several distinct counts in one aggregation would cost.
    """
    ok = F.col("comparable")
    delta, platform = F.col(f"d_{column}"), F.col(f"{column}_platform")
    size = F.when(ok, F.abs(delta))
    over = ok & ~within_tolerance(delta, platform, atol, rtol)  # NULL delta: neither over nor within
    return diff.groupBy("request_id", "pass").agg(
        F.count_if(F.col("side") != "platform_only").alias("n_local_rows"),
        F.count_if(F.col("side") != "local_only").alias("n_platform_rows"),
        F.count_if("captured").alias("n_matched"),
        F.count_if(ok).alias("n_comparable"),
        F.count_if(F.col("captured") & ~ok).alias("n_diverged"),
        F.count_if(over).alias("n_over"),
        F.count_if(ok & within_tolerance(delta, platform, atol, rtol)).alias("n_within"),
        F.count_if(~F.col("has_fingerprint")).alias("n_unprinted"),
        F.max(size).alias("max_abs"),
        F.sum(size).alias("sum_abs"),
        F.count(size).alias("n_abs"),
        F.max(size / F.greatest(F.abs(platform), F.lit(RELATIVE_FLOOR))).alias("max_rel"),
    )


_TOTALS = [
    "n_local_rows", "n_platform_rows", "n_matched", "n_comparable", "n_diverged", "n_over",
    "n_within", "n_unprinted", "sum_abs", "n_abs",
]


def _levels(folded: DataFrame) -> DataFrame:
    """Totals over everything (``level`` 'all') and per pass, from one aggregation chain.

    A folded row counts once for its request as a whole and once for its pass;
    grouping by request before grouping by level makes "how many requests have
    any" a plain count.
    """
    def entry(level, at):
        return F.struct(F.lit(level).alias("level"), at.alias("at"))

    entries = folded.select(
        "*", F.explode(F.array(entry("all", F.lit(None).cast("int")), entry("pass", F.col("pass")))).alias("e")
    )
    per_request = entries.groupBy("request_id", "e.level", "e.at").agg(
        *[F.sum(c).alias(c) for c in _TOTALS],
        F.max("max_abs").alias("max_abs"),
        F.max("max_rel").alias("max_rel"),
        F.min(F.when(F.col("n_over") > 0, F.col("pass"))).alias("first_over"),
    )
    return per_request.groupBy("level", "at").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TOTALS],
        F.count_if(F.col("n_matched") > 0).alias("n_requests_captured"),
        F.count_if(F.col("n_local_rows") > 0).alias("n_requests_local"),
        F.count_if(F.col("n_diverged") > 0).alias("n_requests_diverged"),
        F.count_if(F.col("n_unprinted") > 0).alias("n_requests_unprinted"),
        F.max("max_abs").alias("max_abs"),
        F.max("max_rel").alias("max_rel"),
        F.min("first_over").alias("first_over"),
    )


def divergence_by_pass(
    diff: DataFrame, *, column: str = "std", atol: float = COMPARE_ATOL, rtol: float = COMPARE_RTOL
) -> DataFrame:
    """Per pass: the largest delta, requests diverged there, requests diverging there first.

    Everything below the fold is grouped by request, so it runs in the partitions the flags made.
    """
    here = F.col("n_diverged") > 0
    first = F.min(F.when(here, F.col("pass"))).over(Window.partitionBy("request_id"))
    folded = _by_request_pass(diff, column, atol, rtol).withColumn("_first", first)
    return folded.groupBy("pass").agg(
        F.max("max_abs").alias("max_abs_d"),
        F.sum("n_comparable").alias("n_comparable"),
        F.count_if(here).alias("n_requests_diverged"),
        F.count_if(F.col("pass") == F.col("_first")).alias("n_first_diverged"),
    )


def summarise(
    diff: DataFrame, *, column: str = "std", atol: float = COMPARE_ATOL, rtol: float = COMPARE_RTOL
) -> DataFrame:
    """The one-row verdict; judged on comparable rows, failed by platform-only rows."""
    levels = _levels(_by_request_pass(diff, column, atol, rtol))
    everything = F.col("level") == "all"
    counts = [
        "n_local_rows", "n_platform_rows", "n_matched", "n_comparable", "n_diverged", "n_over", "n_within",
        "n_requests_captured", "n_requests_local", "n_requests_diverged", "n_requests_unprinted",
    ]
    compared = (F.col("level") == "pass") & F.col("at").isNotNull() & (F.col("n_comparable") > 0)
    diverged = (F.col("level") == "pass") & F.col("at").isNotNull() & (F.col("n_requests_diverged") > 0)

    def listed(condition, value):
        # one entry per pass number
        return F.array_sort(F.collect_list(F.when(condition, value)))

    one = levels.agg(
        *[F.coalesce(F.max(F.when(everything, F.col(c))), F.lit(0)).alias(c) for c in counts],
        *[
            F.max(F.when(everything, F.col(c))).alias(c)
            for c in ("sum_abs", "n_abs", "max_abs", "max_rel", "first_over")
        ],
        listed(compared, F.col("at")).alias("passes"),
        F.map_from_entries(listed(compared, F.struct("at", "max_abs"))).alias("max_abs_d_by_pass"),
        F.map_from_entries(listed(diverged, F.struct("at", "n_requests_diverged"))).alias(
            "decode_divergence_by_pass"
        ),
    )
    within = (F.col("n_comparable") > 0) & (F.col("n_within") == F.col("n_comparable"))
    platform_only = F.col("n_platform_rows") - F.col("n_matched")
    return one.select(
        "n_local_rows",
        "n_platform_rows",
        "n_matched",
        (F.col("n_local_rows") - F.col("n_matched")).alias("n_local_only"),
        platform_only.alias("n_platform_only"),
        "n_requests_captured",
        "n_requests_local",
        F.col("max_abs").alias(f"max_abs_d_{column}"),
        F.try_divide("sum_abs", "n_abs").alias(f"mean_abs_d_{column}"),
        F.col("max_rel").alias(f"max_rel_d_{column}"),
        F.col("n_over").alias("n_over_tol"),
        within.alias("within_tol"),
        F.col("first_over").alias("first_divergent_pass"),
        F.lit(atol).alias("tol"),
        F.lit(rtol).alias("rtol"),
        "n_comparable",
        F.col("n_diverged").alias("n_decode_diverged"),
        F.col("n_requests_diverged").alias("n_requests_decode_diverged"),
        F.col("n_requests_unprinted").alias("n_requests_without_fingerprint"),
        (within & (platform_only == 0)).alias("passed"),
        "passes",
        "max_abs_d_by_pass",
        "decode_divergence_by_pass",
    )
