import datetime as dt

import pytest
from pyspark.sql import functions as F

from profilewatch.operators import band as B
from profilewatch.operators import panel as BATCH

from profilewatch.streaming import panel as S
from tests.planted import EMBED

SCHEMA = "time timestamp, request_id string, layer int, pass int, value double, id long"


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def stream_of(spark, folder, *batches, schema=SCHEMA):
    """Each batch is one file; one file per trigger, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .option("latestFirst", "false").parquet(str(folder))
    )


FIRST = [
    (at(1, 1), "ramp", 0, 1, 1.0, 1), (at(1, 2), "ramp", 1, 1, 3.0, 2),
    (at(1, 3), "ramp", 0, 2, 1.0, 3), (at(1, 4), "ramp", 0, 2, 9.0, 4),      # a double write, the lower id stays
    (at(1, 5), "flat", 0, 1, 2.0, 5), (at(1, 6), "flat", 1, 2, 2.0, 6), (at(1, 7), "short", 0, 1, 1.0, 7),
]
SECOND = [(at(2, 1), "ramp", 0, 1, 5.0, 8), (at(2, 5), "ramp", 1, 2, 5.0, 9)]
LAST = [(at(4, 1), "end", 0, 1, 1.0, 10)]


def test_panel_equals_the_batch_numbers_per_finished_day(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", FIRST, SECOND, LAST)
    scores = S.streaming_scores(stream, "1 day", "1 hour", cv_mean=0.5, cv_sd=0.1, layers=(0, 1), passes=(1, 2))
    done = S.run_available(spark, S.streaming_summary(scores, "1 day"), "t-panel").orderBy("window_start").collect()
    assert [r["window_start"].day for r in done] == [1, 2]                   # day 4 is still open
    first, second = done
    # ramp (1, 3): cv 0.5, z 0; flat: cv 0, z -5
    assert (first["sample_count"], first["n_incomplete"], first["flattened_rate"]) == (2, 1, 0.5)
    assert first["mean_cv"] == pytest.approx(0.25) and first["mean_z_cv"] == pytest.approx(-2.5)
    assert (second["sample_count"], second["mean_cv"]) == (1, 0.0)


@pytest.fixture(scope="module")
def healthy(spark):
    cells = [(f"h{i}", k, p, float(k + 1 + i * 0.1 * (p + k * k))) for i in range(5) for k in (0, 1, 2) for p in (1, 2)]
    df = spark.createDataFrame(cells, "request_id string, layer int, pass int, value double")
    return B.fit_band(df, layers=(0, 1, 2), passes=(1, 2))


def test_scores_of_a_stream_equal_those_of_the_batch(spark, tmp_path, healthy):
    """Two days over several files, copies and gaps; the batch sees each finished day on its own."""
    import random

    rng = random.Random(4)
    rows = [
        (at(1 + i % 2, rng.randrange(20)), f"r{rng.randrange(12)}", rng.randrange(4), rng.randrange(1, 4),
         rng.choice([None, float("nan"), rng.random() + 0.1, rng.random() + 3]), i)
        for i in range(400)
    ]
    scope = {"layers": (0, 1, 2), "passes": (1, 2)}
    stream = stream_of(spark, tmp_path / "in", rows[:150], rows[150:], [(at(6, 1), "end", 0, 1, 1.0, 999)])
    scores = S.streaming_scores(stream, "1 day", "30 hours", band=healthy, **scope)
    columns = ["cv", "z_cv", "corr", "max_abs_z_layer", "slope", "cv_pass_slope", "is_flattened", "n_passes_used"]
    done = S.run_available(spark, scores.drop("time"), "t-scores").collect()
    got = {(r["window_start"].day, r["request_id"]): [r[c] for c in columns] for r in done}
    assert {d for d, _ in got} == {1, 2}
    from profilewatch.functions.numeric import nan_to_null
    from profilewatch.operators.cells import first_per_key

    frame = spark.createDataFrame(rows, SCHEMA)
    for day in (1, 2):
        inside = F.col("layer").isin(0, 1, 2) & F.col("pass").isin(1, 2)
        one = frame.filter(F.dayofmonth("time") == day).select(
            "request_id", *[F.when(inside, F.col(c)).alias(c) for c in ("layer", "pass")],
            F.when(inside, nan_to_null(F.col("value"))).alias("value"), "id",
        )
        batch = BATCH.read_request_scores(first_per_key(one, ["request_id", "layer", "pass"], ["value"]), healthy, **scope)
        for r in batch.collect():
            assert got.pop((day, r["request_id"])) == pytest.approx([r[c] for c in columns])
    assert not got


def test_histogram_of_every_finished_window(spark, tmp_path, healthy):
    stream = stream_of(spark, tmp_path / "in", FIRST, SECOND, LAST)
    scores = S.streaming_scores(stream, "1 day", "1 hour", band=healthy, layers=(0, 1), passes=(1, 2))
    path = str(tmp_path / "out")
    S.start_distribution(scores, path, column="cv", n_bands=4).awaitTermination()
    done = spark.read.parquet(path).orderBy("window_start", "band").collect()
    first = [r for r in done if r["window_start"].day == 1]
    assert [(r["band"], r["lower"], r["upper"], r["count"], r["fraction"]) for r in first] == [
        (1, 0.0, 0.125, 1, 0.5), (2, 0.125, 0.25, 0, 0.0), (3, 0.25, 0.375, 0, 0.0), (4, 0.375, 0.5, 1, 0.5),
    ]
    assert [(r["lower"], r["upper"], r["count"]) for r in done if r["window_start"].day == 2] == [(0.0, 0.0, 1)]


def test_the_lowest_id_of_a_double_write_leaves_whatever_came_first(spark, tmp_path):
    schema = "time timestamp, request_id string, signal_type string, forward_pass_index string, value double, id long"
    first = [(at(1, 1), "r", EMBED, "1", 9.0, 9), (at(1, 1), "r", EMBED, "2", 1.0, 1)]
    second = [(at(1, 2), "r", EMBED, "1", 3.0, 3), (at(1, 9), "r", EMBED, "1", 5.0, 5)]   # 9 h is a write of its own
    last = [(at(3, 1), "end", EMBED, "1", 0.0, 7)]
    stream = stream_of(spark, tmp_path / "in", first, second, last, schema=schema)
    done = S.run_available(spark, S.lowest_of_double_writes(stream, "2 hours", "3 hours", ["value"]), "t-lowest").collect()
    got = sorted((r["forward_pass_index"], r["id"], r["value"], r["n_copies"], r["first_time"].hour) for r in done)
    assert got == [("1", 3, 3.0, 2, 1), ("1", 5, 5.0, 1, 9), ("2", 1, 1.0, 1, 1)]


def test_missing_values_scope_and_late_passes_count_as_in_the_batch(spark):
    nan = float("nan")
    rows = [
        (at(1, 1), "hole", 0, 2, 1.0, 1), (at(1, 2), "hole", 1, 3, nan, 2),          # pass 3 has no value
        (at(1, 1), "void", 0, 2, 1.0, 3), (at(1, 2), "void", 0, 3, None, 4),
        (at(1, 1), "late", 0, 1, 2.0, 5), (at(1, 1), "late", 1, 65, 2.0, 6),         # 65 is not 1
        (at(1, 1), "out", 23, 2, 1.0, 7), (at(1, 1), "out", 23, 3, 1.0, 8),          # a layer outside
    ]
    stream = spark.createDataFrame(rows, SCHEMA)
    done = S.streaming_scores(stream, "1 day", "1 hour", cv_mean=0.5, cv_sd=0.1, layers=(0, 1), passes=range(1, 70))
    got = {r["request_id"]: (r["n_passes_used"], r["cv"]) for r in done.collect()}
    assert got == {"hole": (1, None), "void": (1, None), "late": (2, 0.0), "out": (0, None)}


def test_late_rows_do_not_reopen_a_day(spark, tmp_path):
    # a day leaves the state one batch after the watermark has passed it
    more, late = [(at(4, 2), "end", 0, 2, 1.0, 12)], [(at(1, 8), "late", 0, 1, 1.0, 11)]
    stream = stream_of(spark, tmp_path / "in", FIRST, LAST, more, late)
    done = S.run_available(spark, S.capture_progress(stream, "1 day", "1 hour", 3), "t-progress").collect()
    assert [(r["window_start"].day, r["seen"], r["complete"], r["n_rows"]) for r in done] == [(1, 3, True, 7)]


def test_double_writes_pass_once(spark, tmp_path):
    schema = "time timestamp, request_id string, signal_type string, forward_pass_index string"
    rows = [(at(1, 1), "r", EMBED, "1"), (at(1, 1), "r", EMBED, "1"), (at(1, 1), "r", EMBED, "2")]
    stream = stream_of(spark, tmp_path / "in", rows, rows[:1], schema=schema)
    done = S.run_available(spark, S.drop_double_writes(stream, "1 day"), "t-dedup")
    assert sorted(r["forward_pass_index"] for r in done.collect()) == ["1", "2"]


def test_a_restarted_query_continues_from_its_checkpoint(spark, tmp_path):
    path = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        S.start_to_table(S.capture_progress(stream, "1 day", "1 hour", 3), path).awaitTermination()
        return {(r["window_start"].day, r["seen"]) for r in spark.read.parquet(path).collect()}

    spark.createDataFrame(FIRST, SCHEMA).write.parquet(str(tmp_path / "in" / "b0"))
    spark.createDataFrame(SECOND, SCHEMA).write.parquet(str(tmp_path / "in" / "b1"))
    assert run() == {(1, 3)}
    spark.createDataFrame(LAST, SCHEMA).write.parquet(str(tmp_path / "in" / "b2"))
    assert run() == {(1, 3), (2, 1)}
    assert spark.read.parquet(path).filter(F.col("seen") == 3).count() == 1
