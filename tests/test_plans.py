"""What the plans must keep: pruning, pushdown, few exchanges, split hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from profilewatch.operators import cells as C
from profilewatch.operators import paired, parity, replay
from profilewatch.operators import profile as P
from profilewatch.sources import readers
from tests.planted import EMBED, LAYER, SCOPE

WINDOW = ("2024-01-01 00:00:00+00", "2024-01-02 00:00:00+00")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Signal rows where one request holds most of the table, and payloads, as parquet."""
    folder = tmp_path_factory.mktemp("stored")
    n = 60_000
    hot = F.col("id") % 3 != 0
    rows = spark.range(n).select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id").cast("string"))).alias("request_id"),
        F.concat(F.lit(LAYER), (F.col("id") % 5).cast("string")).alias("signal_type"),
        (F.col("id") % 7 + 1).cast("string").alias("forward_pass_index"),
        (F.col("id") % 101 + 1).cast("double").alias("std"),
        *[F.lit(0.0).alias(c) for c in ("mean", "norm", "sparsity", "saturation")],
        F.lit(None).cast("timestamp").alias("time"),
        "id",
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    rows.write.parquet(str(folder / "signals"))
    rows.select("request_id").distinct().select(
        "request_id",
        F.lit("2024-01-01 12:00:00").cast("timestamp").alias("timestamp"),
        F.lit("m").alias("model_id"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit("{}").alias("payload"),
    ).write.parquet(str(folder / "payloads"))
    return spark.read.parquet(str(folder / "signals")), spark.read.parquet(str(folder / "payloads"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def set_conf(spark, monkeypatch_values):
    old = {k: spark.conf.get(k, None) for k in monkeypatch_values}
    for k, v in monkeypatch_values.items():
        spark.conf.set(k, v)
    return old


def restore(spark, old):
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scan_reads_only_what_the_panel_needs(stored):
    signals, payloads = stored
    rows = readers.layer_signals_in_window(signals, payloads, WINDOW, model_id="m", passes=(2, 3))
    plan = plan_of(C.typed_cells(rows, **SCOPE))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    fact = next(s for s in schemas if "std" in s)
    assert "norm" not in fact and "saturation" not in fact and "payload" not in "".join(schemas)
    assert "In(forward_pass_index, [2,3])" in plan and "In(signal_type" in plan and "LeftSemi" in plan
    assert "EqualTo(model_id,m)" in plan and "GreaterThanOrEqual(timestamp" in plan


def test_statistics_need_two_exchanges_and_hash_aggregates_only(stored):
    plan = plan_of(P.request_statistics(C.typed_cells(stored[0], **SCOPE), **SCOPE))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Window" not in plan


def test_copies_of_a_hot_request_fold_before_the_shuffle(spark, stored):
    cells = C.typed_cells(stored[0], **SCOPE)
    df = cells.groupBy("request_id").count()
    hot = df.filter("request_id = 'hot'").first()
    assert hot["count"] <= len(SCOPE["layers"]) * len(SCOPE["passes"]) + 1


SMALL_SHUFFLES = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.files.maxPartitionBytes": "64KB",
    "spark.sql.files.openCostInBytes": "1KB",
}


@pytest.fixture
def small_shuffles(spark):
    """Thresholds scaled down, so that the planted hot keys count as skewed."""
    old = set_conf(spark, SMALL_SHUFFLES)
    yield
    restore(spark, old)


def test_a_hot_request_is_split_in_the_semi_join(spark, stored, small_shuffles):
    signals, payloads = stored
    rows = readers.signals_in_window(signals.repartition(16), payloads, WINDOW)
    cells = C.typed_cells(rows, **SCOPE)
    got = cells.collect()
    assert "skew=true" in plan_of(cells)
    plain = C.typed_cells(signals, **SCOPE).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)


def test_copies_of_one_prompt_are_split_in_the_text_join(spark, small_shuffles):
    same = F.lit("the same question " * 20)
    prompts = spark.range(0, 6000, 1, 16).select(
        F.col("id").cast("string").alias("request_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("question "), F.col("id").cast("string"))).otherwise(same).alias("prompt"),
    )
    pack = prompts.select(F.col("request_id").alias("prompt_id"), "prompt", F.col("request_id").cast("int").alias("position"))
    found = replay.request_by_text(prompts, pack)
    rows = found.collect()
    assert "skew=true" in plan_of(found)
    assert len(rows) == 6000 and sum(r["prompt_id"] == "5999" for r in rows) == 4000


def test_candidates_of_one_control_are_split(spark, small_shuffles):
    candidates = spark.range(0, 60_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1)).cast("string").alias("control_id"),
        F.col("id").cast("double").alias("z_cv"),
        F.concat(F.lit("p"), F.sha2(F.col("id").cast("string"), 256)).alias("prompt_id"),
    )
    controls = candidates.groupBy("control_id").agg(F.min("z_cv").alias("z_cv"))
    pairs = paired.match_controls(candidates, controls, ["z_cv"])
    assert len(pairs.collect()) == 60_000 and "skew=true" in plan_of(pairs)


def test_two_captures_meet_in_one_exchange(stored):
    signals = stored[0]
    named = signals.withColumn(
        "signal_type", F.when(F.col("signal_type") == LAYER + "0", F.lit(EMBED)).otherwise(F.col("signal_type"))
    )
    pairs = plan_of(parity.paired_rows(named, named))
    assert pairs.count("Exchange hashpartitioning") == 1 and "Join" not in pairs
    assert "SortAggregate" not in pairs


def test_a_comparison_scans_each_capture_once(spark, stored, tmp_path):
    """Flags come from the settled pairs; a plan over them reads no file."""
    signals = stored[0]
    assert plan_of(parity.paired_rows(signals, signals)).count("FileScan") == 2
    for df in (parity.summarise(parity.diff_rows(signals, signals)), parity.divergence_by_pass(parity.diff_rows(signals, signals))):
        assert "FileScan" not in plan_of(df)


@pytest.fixture(scope="module")
def captures(spark, stored, tmp_path_factory):
    named = stored[0].withColumn(
        "signal_type", F.when(F.col("signal_type") == LAYER + "0", F.lit(EMBED)).otherwise(F.col("signal_type"))
    )
    folder = str(tmp_path_factory.mktemp("captures"))
    other = named.withColumn("std", F.col("std") + F.when(F.col("id") % 11 == 0, F.lit(0.25)).otherwise(F.lit(0.0)))
    parity.store_capture(named, "plan_captures", "ours", folder, buckets=8)
    parity.store_capture(other, "plan_captures", "theirs", folder, buckets=8)
    with pytest.raises(ValueError, match="already holds"):
        parity.store_capture(other, "plan_captures", "theirs", folder, buckets=8)
    yield named, other
    spark.sql("DROP TABLE plan_captures")


def test_stored_captures_are_compared_in_their_buckets(spark, captures):
    diff = parity.diff_stored(spark, "plan_captures", "ours", "theirs")
    plan = plan_of(diff)
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and "Bucketed: true" in plan
    # only the totals over all requests, a row per pass, are exchanged
    assert plan_of(parity.divergence_by_pass(diff)).count("Exchange") == 1
    plain = parity.diff_rows(*captures)
    assert sorted(map(repr, diff.collect())) == sorted(map(repr, plain.collect()))
    same = parity.summarise(parity.diff_stored(spark, "plan_captures", "ours", "ours")).first()
    assert same["passed"] and same["n_over_tol"] == 0 and same["n_platform_only"] == 0


def test_layer_profiles_fold_the_cells_once(stored):
    plan = plan_of(P.layer_profiles(C.typed_cells(stored[0], **SCOPE)))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_rows_of_a_hot_request_are_split_in_the_flag_join(spark, small_shuffles):
    rows = spark.range(0, 40_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise(F.lit("hot")).alias("request_id"),
        F.when(F.col("id") % 100 < 3, F.lit(EMBED)).otherwise(F.concat(F.lit(LAYER), F.col("id").cast("string")))
        .alias("signal_type"),
        (F.col("id") % 6 + 1).cast("string").alias("forward_pass_index"),
        F.col("id").cast("double").alias("std"),
        "id",
    )
    diff = parity.diff_rows(rows, rows)
    assert len(diff.collect()) == rows.select("request_id", "signal_type", "forward_pass_index").distinct().count()
    assert "skew=true" in plan_of(diff)
