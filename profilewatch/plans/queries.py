"""Named queries over the test tables; each key has an oracle in ``plans.oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CELL_KEYS, SCALARS
from ..functions.numeric import nan_to_null
from ..functions import signals as S
from ..functions import text as X
from ..functions.distributions import chi_square_cdf
from ..functions.vectors import leading_dims
from ..operators import band as B
from ..operators import detectors
from ..operators import cells as C
from ..operators import manifold as M
from ..operators import paired, panel, parity, replay, score, textgate
from ..operators import profile as P
from ..operators import vectors as V
from ..operators.quantiles import exact_quantiles
from ..session import configure, scratch_path, settle
from ..sources import manifest, packs, poll, readers, snapshot, tables
from ..sources.tables import (
    DENSE_LAYERS, LAYERS, PASSES, STREAM_DELAY, STREAM_EVERY, VECTOR_WINDOW, WINDOW, table,
)
from ..streaming import panel as stream

SCOPE = {"layers": LAYERS, "passes": PASSES}
DENSE = {"layers": DENSE_LAYERS, "passes": PASSES}
SIGNAL_TYPES = S.layer_signal_names(len(LAYERS))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def r6(c: Column | str) -> Column:
    """Rounded for comparison across engines; adding zero drops a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# ---------------------------------------------------------------- shared inputs


def _window_rows(spark, sf_dir):
    return readers.signals_in_window(
        tables.sparse_signals(spark, sf_dir),
        tables.payloads(spark, sf_dir),
        WINDOW,
        signal_types=SIGNAL_TYPES,
        passes=PASSES,
    )


def _sparse_cells(spark, sf_dir):
    return C.typed_cells(tables.sparse_signals(spark, sf_dir), **SCOPE)


def _dense_cells(spark, sf_dir):
    return C.typed_cells(tables.dense_signals(spark, sf_dir), **DENSE)


def _band(spark, sf_dir):
    """Fitted on complete grids with the scope of the sparse requests."""
    dense = tables.dense_signals(spark, sf_dir, len(LAYERS))
    return B.fit_band(C.typed_cells(dense, **SCOPE), **SCOPE)


def _scores(spark, sf_dir):
    cells = C.typed_cells(_window_rows(spark, sf_dir), **SCOPE)
    return panel.read_request_scores(cells, _band(spark, sf_dir), **SCOPE)


# ------------------------------------------------------------- readers, parsing


@query
def signal_reader(spark, sf_dir):
    rows = readers.read_signals(
        tables.sparse_signals(spark, sf_dir),
        tables.payloads(spark, sf_dir),
        WINDOW,
        signal_types=SIGNAL_TYPES,
        passes=PASSES,
    )
    return rounded(rows, *SCALARS).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query
def signal_reader_one_model(spark, sf_dir):
    rows = readers.read_signals(
        tables.sparse_signals(spark, sf_dir), tables.payloads(spark, sf_dir), WINDOW, model_id="O"
    )
    return rows.groupBy("signal_type", "forward_pass_index").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("std")).alias("mean_std")
    )


@query
def signals_polled_again(spark, sf_dir):
    """Two polls of a growing table; late rows are found in the overlap."""
    then, now = tables.growing_signals(spark, sf_dir)
    store = scratch_path(spark, "polls")
    overlap = F.make_dt_interval(days=F.lit(tables.LATE_BY_DAYS))
    poll.poll(then, store, overlap=overlap)
    found = poll.poll(now, store, overlap=overlap)
    return rounded(found, *SCALARS).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query
def prompt_reader(spark, sf_dir):
    found = readers.read_prompts(
        tables.chat_payloads(spark, sf_dir), tables.CHAT_WINDOW
    )
    return found.select(
        "request_id", F.unix_timestamp("timestamp").alias("at"), "prompt",
        F.length("prompt").cast("long").alias("n_chars"),
    )


@query
def layer_parse(spark, sf_dir):
    rows = tables.captures(spark, sf_dir)[1].select("signal_type", "forward_pass_index")
    other = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("signal_type"), F.col("props").alias("forward_pass_index")
    )
    both = rows.unionByName(other)
    return both.groupBy(
        "signal_type",
        S.layer_of(F.col("signal_type")).cast("long").alias("layer"),
        S.layer_or_unknown(F.col("signal_type")).cast("long").alias("layer_or_unknown"),
        S.pass_number(F.col("forward_pass_index")).cast("long").alias("pass"),
        S.position_rule(F.col("signal_type")).alias("position_rule"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def layer_parse_strict(spark, sf_dir):
    """Every name must be a layer; one that is none would fail the job."""
    rows = tables.captures(spark, sf_dir)[0]
    layer = S.layer_of_strict(F.col("signal_type")).cast("long").alias("layer")
    return rows.groupBy(layer).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def unreadable_passes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("props").alias("forward_pass_index"))
    lines = tables.sparse_signals(spark, sf_dir).select("forward_pass_index")
    return C.unreadable_passes(rows.unionByName(lines))


@query
def pass_budget(spark, sf_dir):
    rows = C.within_pass_budget(tables.sparse_signals(spark, sf_dir), 5)
    return rows.groupBy("forward_pass_index").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def last_generation_pass(spark, sf_dir):
    found = C.last_generation_pass(tables.sparse_signals(spark, sf_dir))
    return found.withColumn("last_pass", F.col("last_pass").cast("long"))


@query
def scalars_csv_roundtrip(spark, sf_dir):
    """Scalar rows to CSV and back; the pass comes back as text."""
    rows = readers.read_signals(
        tables.sparse_signals(spark, sf_dir), tables.payloads(spark, sf_dir), WINDOW
    )
    path = scratch_path(spark, "scalars") + ".csv"
    readers.write_csv(rows, path)
    return readers.read_table(spark, path).groupBy("forward_pass_index", "signal_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        r6(F.sum("std")).alias("sum_std"),
        F.date_format(F.max("time"), "yyyy-MM-dd").alias("last_day"),
    )


@query
def captured_rows_roundtrip(spark, sf_dir):
    """Capture rows made from hidden states, stored and read back."""
    path = scratch_path(spark, "captured")
    readers.write_captured(
        V.capture_rows(tables.hidden_states(spark, sf_dir), keep_dims=48), path
    )
    back = readers.read_table(spark, path)
    return rounded(back, *SCALARS)


# ------------------------------------------------------------ profiles and band


@query
def profile_by_layer(spark, sf_dir):
    found = P.layer_profiles(_sparse_cells(spark, sf_dir))
    return found.select("request_id", F.col("layer").cast("long").alias("layer"), r6("v").alias("v"))


@query
def variation_by_pass(spark, sf_dir):
    found = P.variation_by_pass(_sparse_cells(spark, sf_dir))
    return found.select("request_id", F.col("pass").cast("long").alias("pass"), r6("cv").alias("cv"))


@query
def profile_statistics(spark, sf_dir):
    stats = P.request_statistics(_sparse_cells(spark, sf_dir), **SCOPE)
    return rounded(stats, "cv", "slope", "cv_pass_slope")


@query
def layer_z_scores(spark, sf_dir):
    found = P.layer_z_scores(_sparse_cells(spark, sf_dir), _band(spark, sf_dir))
    return found.select(
        "request_id", F.col("layer").cast("long").alias("layer"), r6("v").alias("v"), r6("z").alias("z")
    )


@query
def request_arrays(spark, sf_dir):
    """The array form of the statistics, unpacked by position."""
    stats = P.request_statistics(
        _dense_cells(spark, sf_dir), B.fit_band(_dense_cells(spark, sf_dir), **DENSE), arrays=True, **DENSE
    )
    return stats.select(
        "request_id", F.posexplode(F.arrays_zip("profile", "z_by_layer"))
    ).select(
        "request_id",
        F.col("pos").cast("long").alias("layer"),
        r6("col.profile").alias("v"),
        r6("col.z_by_layer").alias("z"),
    )


@query
def complete_requests(spark, sf_dir):
    return B.complete_requests(_dense_cells(spark, sf_dir), **DENSE)


@query
def fit_band(spark, sf_dir):
    found = B.fit_band(_dense_cells(spark, sf_dir), **DENSE).range()
    return rounded(
        found, "cv_mean", "cv_sd", "slope_mean", "slope_sd", "cv_low", "cv_high"
    ).drop("layers", "passes", "profile_mean", "profile_sd")


@query
def band_layers(spark, sf_dir):
    found = B.fit_band(_dense_cells(spark, sf_dir), **DENSE).layer()
    return rounded(found, "profile_mean", "profile_sd").withColumn("layer", F.col("layer").cast("long"))


@query
def band_saved_and_loaded(spark, sf_dir):
    """A band fitted on a named set of requests, written and read back."""
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("request_id"))
    path = scratch_path(spark, "band")
    B.fit_band(_dense_cells(spark, sf_dir), named, **DENSE).save(path)
    frame = B.load_band(spark, path).frame
    return rounded(frame, "cv_mean", "cv_sd", "slope_mean", "slope_sd").select(
        "cv_mean", "cv_sd", "slope_mean", "slope_sd", "n_requests", "version"
    )


# ------------------------------------------------------------------------ panel


@query
def request_scores(spark, sf_dir):
    found = panel.scored_only(_scores(spark, sf_dir))
    return rounded(found, "cv", "z_cv", "corr", "slope", "max_abs_z_layer", "cv_pass_slope")


@query
def window_summary(spark, sf_dir):
    found = panel.window_summary(_scores(spark, sf_dir), _band(spark, sf_dir))
    return rounded(
        found, "flattened_rate", "healthy_rate", "mean_cv", "mean_z_cv", "mean_corr",
        "reference_cv_mean", "reference_cv_sd",
    )


@query
def empty_window_summary(spark, sf_dir):
    """A window without a request: zeros beside the band."""
    rows = readers.signals_in_window(
        tables.sparse_signals(spark, sf_dir), tables.payloads(spark, sf_dir),
        ("1970-01-01 00:00:00+00", "1970-01-02 00:00:00+00"), signal_types=SIGNAL_TYPES, passes=PASSES,
    )
    band = _band(spark, sf_dir)
    found = panel.window_summary(panel.read_request_scores(C.typed_cells(rows, **SCOPE), band, **SCOPE), band)
    return rounded(found, "reference_cv_mean", "reference_cv_sd")


@query
def score_distribution(spark, sf_dir):
    return rounded(panel.score_distribution(_scores(spark, sf_dir)), "lower", "upper", "fraction")


@query
def snapshot_census(spark, sf_dir):
    return snapshot.freeze(
        tables.sparse_signals(spark, sf_dir),
        tables.payloads(spark, sf_dir),
        scratch_path(spark, "snapshot"),
        WINDOW,
        **SCOPE,
    )


@query
def snapshot_complete_ids(spark, sf_dir):
    """The complete requests of a frozen window, as the freeze wrote them."""
    folder = scratch_path(spark, "snapshot-ids")
    dense = tables.dense_signals(spark, sf_dir, len(LAYERS))
    snapshot.freeze(dense, tables.payloads(spark, sf_dir), folder, WINDOW, **SCOPE)
    return snapshot.complete_ids(spark, folder)


@query
def capture_description(spark, sf_dir):
    rows = tables.captures(spark, sf_dir)[0]
    turns = table(spark, sf_dir, "conversations").select(
        F.length("text").alias("n_prompt_tokens"), F.col("turn").alias("n_generated_tokens")
    )
    return snapshot.capture_description(rows, turns).select("json")


# -------------------------------------------------------------- vectors, manifold


@query
def vector_scalars(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "v", F.transform("embedding", lambda x: x * 8)
    )
    found = rows.select("vec_id", *V.scalar_columns(leading_dims(F.col("v"))))
    return rounded(found, *SCALARS)


@query
def position_reduction(spark, sf_dir):
    found = V.reduce_positions(tables.hidden_states(spark, sf_dir))
    return found.select(*CELL_KEYS, "n_positions", F.posexplode("vector")).select(
        *CELL_KEYS, "n_positions", F.col("pos").cast("long").alias("dim"), r6("col").alias("x")
    )


@query
def last_pass_vector(spark, sf_dir):
    found = readers.read_last_vectors(
        tables.vector_signals(spark, sf_dir), tables.vector_payloads(spark, sf_dir), VECTOR_WINDOW
    )
    return found.select(
        "request_id", "forward_pass_index", F.posexplode("embedding_vector")
    ).select(
        "request_id", "forward_pass_index", F.col("pos").cast("long").alias("dim"),
        r6(F.col("col").cast("double")).alias("x"),
    )


@query
def reference_vector(spark, sf_dir):
    """Highest pass without a minimum: a prefill-only request keeps its prefill."""
    rows = tables.vector_signals(spark, sf_dir).withColumnRenamed("embedding_vector", "vector")
    found = V.reference_vectors(rows)
    return found.select(
        "request_id", r6(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total")
    )


def _manifold_scores(spark, sf_dir, mode):
    vectors = tables.half_means(spark, sf_dir)
    model = M.fit_manifold(vectors, mode=mode)
    found = model.score(vectors).withColumn("threshold", F.lit(model.threshold))
    return rounded(found.drop("vector"), "ood_dist", "ood_prob", "threshold")


@query
def manifold_full(spark, sf_dir):
    return _manifold_scores(spark, sf_dir, "full")


@query
def manifold_diagonal(spark, sf_dir):
    return _manifold_scores(spark, sf_dir, "diagonal")


def _stored_manifold(spark, train, **fit):
    path = scratch_path(spark, "manifold")
    M.fit_manifold(train, **fit).save(path)
    return M.load_manifold(spark, path)


@query
def ood_reduced(spark, sf_dir):
    """One principal axis of two, fitted, saved, loaded; an odd number of degrees of freedom."""
    vectors = tables.half_means(spark, sf_dir)
    model = _stored_manifold(spark, vectors, pca_k=1)
    found = model.score(vectors).withColumn("threshold", F.lit(model.threshold))
    return rounded(found.drop("vector"), "ood_dist", "ood_prob", "threshold")


@query
def ood_small_sample(spark, sf_dir):
    """Four training vectors for two dimensions: the stronger shrinkage. All vectors are scored."""
    vectors = tables.half_means(spark, sf_dir)
    model = _stored_manifold(spark, vectors.filter(F.col("request_id").cast("long") < 4), pca_k=2)
    found = model.score(vectors).withColumn("shrinkage", F.lit(model.shrinkage))
    return rounded(found.drop("vector"), "ood_dist", "ood_prob")


@query
def ood_scores(spark, sf_dir):
    """Reduced space: fitted on last generated tokens, saved, loaded, all vectors scored."""
    train = readers.read_last_vectors(
        tables.vector_signals(spark, sf_dir), tables.vector_payloads(spark, sf_dir), VECTOR_WINDOW
    )
    model = _stored_manifold(spark, train, vector="embedding_vector", pca_k=16)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rounded(model.score(rows).drop("vector"), "ood_dist", "ood_prob")


@query
def distance_quantiles(spark, sf_dir):
    probabilities = [0.1, 0.5, 0.95, 0.99]
    values = table(spark, sf_dir, "lineitem").select(F.sqrt("l_extendedprice").alias("x"))
    found = exact_quantiles(values, "x", probabilities)
    return rounded(
        spark.createDataFrame(list(zip(probabilities, found)), "probability double, quantile double"),
        "quantile",
    )


@query
def chi_square_probability(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        chi_square_cdf(F.col("l_quantity"), 32).alias("p32"),
        chi_square_cdf(F.col("l_quantity"), 4).alias("p4"),
    )
    return rows.groupBy("l_quantity").agg(
        r6(F.avg("p32")).alias("p32"), r6(F.avg("p4")).alias("p4"), F.count(F.lit(1)).alias("n_rows")
    )


# ------------------------------------------------------------------------- text


@query
def text_checks(spark, sf_dir):
    found = textgate.text_checks(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "stripped_chars", "char_run", "text_ok", "reason_codes")


@query
def text_reasons(spark, sf_dir):
    """The wording of the reasons, as reports carry it."""
    return textgate.text_checks(table(spark, sf_dir, "documents")).select("doc_id", "text_reasons")


@query
def word_statistics(spark, sf_dir):
    found = textgate.text_measures(table(spark, sf_dir, "documents"))
    return rounded(
        found.select("doc_id", "n_words", "n_distinct_words", "top_word_count", "distinct_ratio", "top_share"),
        "distinct_ratio", "top_share",
    )


@query
def gate_combined(spark, sf_dir):
    vectors = tables.half_means(spark, sf_dir)
    model = M.fit_manifold(vectors, mode="full")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"), "text")
    joined = docs.join(vectors, "request_id", "left")
    found = textgate.run_gate(joined, "text", "vector", model)
    return rounded(
        found.select("request_id", "text_ok", "ood_dist", "is_ood", "gate_ok"), "ood_dist"
    )


@query
def gate_foreign_detector(spark, sf_dir):
    """The gate with a detector from outside, fitted on and asked about all vectors."""
    vectors = tables.half_means(spark, sf_dir)
    foreign = detectors.detector("widest_axis", vectors, dim=2, limit=2.5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"), "text")
    found = textgate.run_gate(docs.join(vectors, "request_id", "left"), "text", "vector", foreign)
    return rounded(
        found.select("request_id", "text_ok", "ood_dist", "ood_prob", "is_ood", "gate_ok"), "ood_dist", "ood_prob"
    )


@query
def prompt_extract(spark, sf_dir):
    rows = tables.chat_payloads(spark, sf_dir)
    found = rows.select("request_id", X.prompt_text(F.col("payload")).alias("prompt"))
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"),
        X.prompt_text(F.col("props")).alias("prompt"),
    )
    return found.unionByName(events)


@query
def response_text(spark, sf_dir):
    rows = tables.answer_bodies(spark, sf_dir)
    return rows.select("conv_id", "turn", X.response_text(F.col("body")).alias("answer"))


def _odd_text() -> Column:
    return F.concat(F.col("text"), F.lit("\\n C:\\new\r\nend \\"))


@query
def escape_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _odd_text().alias("t"))
    line = rows.withColumn("line", X.escape_line(F.col("t")))
    unix = F.replace(F.col("t"), F.lit("\r\n"), F.lit("\n"))
    return line.select(
        "doc_id",
        "line",
        F.contains("line", F.lit("\n")).alias("has_newline"),
        (X.unescape_line(F.col("line")) == unix).alias("restored"),
    )


@query
def prompt_pack(spark, sf_dir):
    """Every turn written as a pack (CSV and lines), read back from the CSV."""
    turns = table(spark, sf_dir, "conversations").select(turn_key(), F.col("text").alias("prompt"))
    folder = scratch_path(spark, "pack")
    packs.write_pack(turns, folder)
    return packs.read_pack(spark, folder)


@query
def prompt_pack_lines(spark, sf_dir):
    """Without a CSV the ids are the line numbers."""
    turns = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn")
    folder = scratch_path(spark, "pack-lines")
    packs.write_pack(turns.select(F.col("text").alias("prompt")), folder, with_csv=False)
    return packs.read_pack(spark, folder)


@query
def prompt_pack_id_column(spark, sf_dir):
    """A CSV that only names the prompts: ids from the CSV, text from the lines."""
    turns = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn")
    folder = scratch_path(spark, "pack-ids")
    packs.write_pack(
        turns.select(turn_key(), F.col("text").alias("prompt")), folder, prompt_column=False
    )
    return packs.read_pack(spark, folder)


def turn_key() -> Column:
    return F.concat_ws("-", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
        "prompt_id"
    )


@query
def restamp_by_text(spark, sf_dir):
    """Documents asked again with other white space, matched to the last equal text."""
    docs = table(spark, sf_dir, "documents")
    theirs = docs.select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.concat(F.lit(" \t"), F.replace("text", F.lit(" "), F.lit(" \n ")), F.lit("\u00a0")).alias("prompt"),
    )
    ours = docs.select(
        F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("prompt_id"),
        F.col("text").alias("prompt"),
        F.col("doc_id").alias("position"),
    )
    mapping = replay.request_by_text(theirs, ours)
    return replay.restamp(docs.select(F.col("doc_id").cast("string").alias("request_id"), "n_chars"), mapping)


# ------------------------------------------------------------------ two captures


def _diff(spark, sf_dir, passes=(1, 2, 3, 4, 5, 6)):
    local, platform = tables.captures(spark, sf_dir)
    return parity.diff_rows(local, platform, passes=passes)


@query
def capture_normalised(spark, sf_dir):
    found = parity.normalised(tables.captures(spark, sf_dir)[0])
    return rounded(found, *SCALARS)


def _compared(found):
    """All five scalars of both sides and their deltas."""
    names = [f"{c}{end}" for c in SCALARS for end in ("_local", "_platform")] + [f"d_{c}" for c in SCALARS]
    found = found.select(
        *CELL_KEYS, *names, "captured", "side",
        F.col("pass").cast("long").alias("pass"), "token_match", "comparable", "has_fingerprint",
    )
    return rounded(found, *names)


@query
def capture_diff(spark, sf_dir):
    return _compared(_diff(spark, sf_dir))


def _stored_diff(spark, sf_dir):
    """Two capture files without ids, where the first of the copies counts, kept as one bucketed table."""
    name, folder = f"captures_{uuid.uuid4().hex}", scratch_path(spark, "captures")
    for side, rows in zip(("mine", "theirs"), tables.captures(spark, sf_dir), strict=True):
        path = f"{folder}/{side}.{'csv' if side == 'mine' else 'parquet'}"
        ordered = rows.orderBy(*CELL_KEYS, F.desc("id")).drop("id")
        readers.write_csv(ordered, path) if side == "mine" else ordered.write.parquet(path)
        parity.store_capture(readers.read_capture(spark, path), name, side, f"{folder}/table")
    return parity.diff_stored(spark, name, "mine", "theirs")


@query
def capture_diff_files(spark, sf_dir):
    return _compared(_stored_diff(spark, sf_dir))


def _summary(found):
    """A summary with its per-pass maps as text."""
    def listed(name, form):
        entries = F.array_sort(F.map_entries(name))
        return F.array_join(F.transform(entries, lambda e: F.format_string(form, e["key"], e["value"])), ",").alias(name)

    maps = ("max_abs_d_by_pass", "decode_divergence_by_pass")
    return rounded(found, "max_abs_d_std", "mean_abs_d_std", "max_rel_d_std").select(
        *[c for c in found.columns if c not in ("passes", *maps)],
        F.array_join(F.col("passes").cast("array<string>"), ",").alias("passes"),
        listed(maps[0], "%d:%.6f"),
        listed(maps[1], "%d:%d"),
    ).withColumn("first_divergent_pass", F.col("first_divergent_pass").cast("long"))


@query
def capture_files_summary(spark, sf_dir):
    return _summary(parity.summarise(_stored_diff(spark, sf_dir)))


@query
def capture_report(spark, sf_dir):
    """The comparison as a file in report order; a row's place in it is read back."""
    path = scratch_path(spark, "report")
    found = parity.sorted_diff(_diff(spark, sf_dir)).select(*CELL_KEYS, "side")
    found.write.parquet(path)
    return packs.with_position(spark.read.parquet(path), [*CELL_KEYS, "side"])


@query
def capture_relabelled(spark, sf_dir):
    """A whole capture under one request id: the first copy of each signal and pass stays."""
    found = parity.normalised(tables.captures(spark, sf_dir)[0], request_id="one")
    return rounded(found, *SCALARS)


@query
def capture_comparability(spark, sf_dir):
    pairs = parity.paired_rows(*tables.captures(spark, sf_dir), passes=None)
    return parity.comparability(pairs).withColumn("pass", F.col("pass").cast("long"))


@query
def capture_summary(spark, sf_dir):
    return _summary(parity.summarise(_diff(spark, sf_dir)))


@query
def capture_by_pass(spark, sf_dir):
    found = parity.divergence_by_pass(_diff(spark, sf_dir))
    return rounded(found, "max_abs_d").withColumn("pass", F.col("pass").cast("long"))


# ------------------------------------------------------------------- score batch


@query
def score_batch(spark, sf_dir):
    """Assistant turns as generated text, the turn before as prompt."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    requests = turns.filter(F.col("role") == "assistant").join(asked, ["conv_id", "turn"], "left").select(
        tables.turn_id().alias("prompt_id"),
        "prompt",
        F.col("text").alias("generated_text"),
        F.size(X.words(F.col("prompt"))).cast("long").alias("n_prompt_tokens"),
        F.size(X.words(F.col("text"))).cast("long").alias("n_generated_tokens"),
    )
    vectors = tables.half_means(spark, sf_dir)
    found = score.score_batch(
        requests,
        _sparse_cells(spark, sf_dir),
        _band(spark, sf_dir),
        vectors,
        M.fit_manifold(vectors, mode="full"),
        **SCOPE,
    )
    codes = {c: r6(c) for c in [
        "cv", "slope", "corr", "z_cv", "z_slope", "max_abs_z_layer", "cv_pass_slope", "ood_dist", "ood_prob",
    ]}
    # ratios inside the wording are compared through word_statistics
    return found.withColumns(codes).drop("text_reasons")


@query
def first_complete_prompts(spark, sf_dir):
    """The first complete requests in id order with their prompts (a report limit)."""
    first = replay.first_requests(B.complete_requests(_dense_cells(spark, sf_dir), **DENSE), 25)
    prompts = readers.read_prompts(tables.payloads(spark, sf_dir), WINDOW, ordered=False)
    return replay.prompts_of(first, prompts).select("request_id", "prompt")


# ------------------------------------------------------------------ paired effect


def _paired(spark, sf_dir):
    """Documents beside the first document of their language and source.

    The measures are settled: a few numbers per document, read by the candidates
    and by their controls, instead of going through the texts twice.
    """
    measures = textgate.text_measures(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("lang").alias("family"),
        F.col("source").alias("question"),
        (F.col("n_words") % 5 + 1).alias("level"),
        F.concat_ws("/", "lang", "source").alias("control_id"),
        F.col("distinct_ratio").alias("z_cv"),
        "n_words",
    )
    measured = settle(measures).filter(F.col("z_cv").isNotNull())
    controls = measured.groupBy("control_id").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("z_cv", "doc_id").alias("z_cv")
    )
    pairs = paired.match_controls(measured, controls, ["z_cv", "doc_id"])
    return pairs.filter(F.col("doc_id") != F.col("control_doc_id"))


@query
def paired_effect(spark, sf_dir):
    found = paired.paired_effect(_paired(spark, sf_dir), "dz_cv")
    return rounded(found, "mean", "t", "p")


@query
def dose_response(spark, sf_dir):
    found = paired.dose_response(_paired(spark, sf_dir), ["family", "question"], "z_cv")
    return rounded(found, "mean", "t", "p")


@query
def selection_census(spark, sf_dir):
    pairs = _paired(spark, sf_dir)
    found = paired.selection_census(
        pairs,
        {
            "candidates": F.lit(True),
            "dz_cv <= -0.1": F.col("dz_cv") <= -0.1,
            "z_cv <= 0.5": F.col("z_cv") <= 0.5,
            "selected": (F.col("dz_cv") <= -0.1) & (F.col("z_cv") <= 0.5),
        },
    )
    return found.withColumn("step", F.col("step").cast("long"))


@query
def strongest_per_question(spark, sf_dir):
    found = paired.strongest_per_question(_paired(spark, sf_dir), "question", "dz_cv", "doc_id")
    return rounded(found, "dz_cv")


# ------------------------------------------------------------------------ replay


@query
def send_outcome(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_type") != "error").alias("ok")
    )
    return replay.send_outcome(log, ["user_id", "day"])


@query
def send_outcome_dry_run(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") != "error").alias("ok"))
    return replay.send_outcome(log, ["user_id"], dry_run=True)


@query
def padded_windows(spark, sf_dir):
    sent = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("b")
    )
    start, end = replay.padded_window(F.col("a"), F.col("b"))
    return sent.select("user_id", start.alias("window_start"), end.alias("window_end"))


# ---------------------------------------------------------------------- manifest


def _listing(spark, sf_dir, changed=None, absent=None):
    """A folder with one text file per language: ids and digests of its documents in id order."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isNotNull())
    if absent is not None:
        docs = docs.filter(F.col("lang") != absent)
    edited = F.when(F.col("lang") == changed, F.lit("edited")).otherwise(F.col("text")) if changed else F.col("text")
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5(F.coalesce(edited, F.lit(""))))
    path = scratch_path(spark, "listing")
    lines = docs.select("lang", "doc_id", line.alias("value")).repartition("lang").sortWithinPartitions("lang", "doc_id")
    lines.drop("doc_id").write.partitionBy("lang").text(path)
    return path


def _language_digests(spark, folder):
    found = manifest.file_digests(spark, folder, "*.txt")
    return found.select(F.regexp_extract("file", r"lang=([^/]*)/", 1).alias("file"), "sha256", "bytes")


def _record(spark, folder, summary, **header):
    digests = _language_digests(spark, folder)
    roles = digests.select(F.concat(F.lit("docs-"), "file").alias("key"), "file", (F.col("file") != "en").alias("tracked"))
    return manifest.manifest_record(manifest.manifest_files(digests, roles), version="v1", summary=summary, **header)


def _stored_record(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    summary = {"window": list(WINDOW), "model_id": "O", "n_requests": 3}
    record = _record(spark, _listing(spark, sf_dir), summary, extra={"note": "first", "runs": 2})
    manifest.write_manifest(record, path)
    return manifest.read_manifest(spark, path)


@query
def manifest_files(spark, sf_dir):
    return _stored_record(spark, sf_dir).files


@query
def manifest_verify(spark, sf_dir):
    """One file is edited and one is gone since the record was made."""
    later = _language_digests(spark, _listing(spark, sf_dir, changed="fr", absent="es"))
    return manifest.verify_manifest(_stored_record(spark, sf_dir), later)


@query
def manifest_refresh(spark, sf_dir):
    again = _record(spark, _listing(spark, sf_dir, changed="fr"), {}, extra={})
    refreshed = manifest.refresh_manifest(_stored_record(spark, sf_dir), again)
    header = refreshed.header.select(
        F.struct(
            "model_id", F.col("counts")["n_requests"].alias("n_requests"),
            F.col("extra")["note"].alias("note"), F.col("extra")["runs"].alias("runs"),
        ).alias("h")
    ).scalar()
    return refreshed.files.withColumn("h", header).select("key", "sha256", "bytes", "tracked", "h.*")


# --------------------------------------------------------------------- streaming


STREAM_SCOPE = {"layers": tables.STREAM_LAYERS, "passes": PASSES}


def _stream_scores(spark, sf_dir):
    """The band is fitted on the complete grids of four layers and stored, as a monitor would load it."""
    dense = tables.dense_signals(spark, sf_dir, len(tables.STREAM_LAYERS))
    path = scratch_path(spark, "stream-band")
    B.fit_band(C.typed_cells(dense, **STREAM_SCOPE), **STREAM_SCOPE).save(path)
    return stream.streaming_scores(
        tables.stream_events(spark, sf_dir), STREAM_EVERY, STREAM_DELAY, band=B.load_band(spark, path),
        layers=tables.STREAM_LAYERS, passes=tables.STREAM_PASSES,
    )


def _by_day(done):
    return done.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def stream_panel(spark, sf_dir):
    summary = stream.streaming_summary(_stream_scores(spark, sf_dir), STREAM_EVERY)
    done = stream.run_available(spark, summary, "panel")
    return _by_day(rounded(done, "flattened_rate", "healthy_rate", "mean_cv", "mean_z_cv", "mean_corr"))


@query
def stream_scores(spark, sf_dir):
    done = stream.run_available(spark, _stream_scores(spark, sf_dir).drop("time"), "scores")
    found = rounded(done, "cv", "z_cv", "corr", "slope", "max_abs_z_layer", "cv_pass_slope")
    return _by_day(found).withColumn("n_passes_used", F.col("n_passes_used").cast("long"))


@query
def stream_distribution(spark, sf_dir):
    """The histogram of every finished day."""
    path = scratch_path(spark, "histogram")
    stream.start_distribution(_stream_scores(spark, sf_dir), path).awaitTermination()
    done = spark.read.parquet(path).drop("batch")
    return _by_day(rounded(done, "lower", "upper", "fraction"))


def _double_writes(spark, sf_dir):
    """Events by user, layer and pass, each written again with a higher id that arrives first."""
    e = tables.stream_events(spark, sf_dir)
    rows = e.select(
        "time", "request_id", S.layer_signal(F.col("layer")).alias("signal_type"),
        F.col("pass").cast("string").alias("forward_pass_index"), nan_to_null(F.col("value")).alias("value"), "id",
    )
    again = rows.withColumns({"id": F.col("id") + 1_000_000_000, "value": F.col("value") + 1})
    return again.unionByName(rows)


@query
def stream_dedup(spark, sf_dir):
    """Of the copies of a cell within half an hour the lowest id leaves."""
    done = stream.lowest_of_double_writes(_double_writes(spark, sf_dir), "30 minutes", STREAM_DELAY, ["value"])
    found = rounded(stream.run_available(spark, done, "dedup"), "value")
    at = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_time", "last_time")}
    return found.withColumns(at)


@query
def stream_dedup_first_arrival(spark, sf_dir):
    """Every event written twice leaves once, without waiting for the watermark."""
    def rows():
        e = tables.stream_events(spark, sf_dir)
        return e.select(
            "time", F.col("id").cast("string").alias("request_id"),
            S.layer_signal(F.col("layer")).alias("signal_type"),
            F.col("pass").cast("string").alias("forward_pass_index"), nan_to_null(F.col("value")).alias("value"),
        )

    done = stream.drop_double_writes(rows().unionByName(rows()), STREAM_DELAY)
    return rounded(stream.run_available(spark, done.drop("time"), "dedup-first"), "value")


@query
def stream_progress(spark, sf_dir):
    expected = table(spark, sf_dir, "events").select("user_id").distinct().count()
    progress = stream.capture_progress(
        tables.stream_events(spark, sf_dir), STREAM_EVERY, STREAM_DELAY, expected
    )
    return stream.run_available(spark, progress, "progress").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd")
    )

