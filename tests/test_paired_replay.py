import math

import pytest
from pyspark.sql import functions as F

from profilewatch.operators import paired as P
from profilewatch.operators import replay as R


@pytest.fixture
def pairs(spark):
    controls = spark.createDataFrame([("c1", 0.0), ("c2", 1.0)], "control_id string, z_cv double")
    rows = [("f", "c1", "q1", 1, -1.0, "a"), ("f", "c1", "q1", 5, -2.0, "b"), ("f", "c2", "q2", 1, -2.0, "c"),
            ("g", "c2", "q2", 5, 2.0, "d"), ("g", "c1", "q1", 1, 1.0, "e"), ("g", "nowhere", "q3", 1, -9.0, "x")]
    df = spark.createDataFrame(rows, "family string, control_id string, question string, level int, z_cv double, id string")
    return P.match_controls(df, controls, ["z_cv"])


def test_effects_are_against_the_own_control(pairs):
    got = {r["id"]: r["dz_cv"] for r in pairs.collect()}
    assert got == {"a": -1.0, "b": -2.0, "c": -3.0, "d": 1.0, "e": 1.0}


def test_family_effect_by_hand(pairs):
    got = {r["family"]: r for r in P.paired_effect(pairs, "dz_cv").collect()}
    f = got["f"]                       # -1, -2, -3: mean -2, sd 1, t = -2 * sqrt(3)
    assert (f["n"], f["mean"]) == (3, -2.0) and f["t"] == pytest.approx(-2 * math.sqrt(3))
    assert f["p"] == pytest.approx(0.07418, abs=1e-5)
    assert got["g"]["t"] is None and got["g"]["p"] is None      # no spread, no test


def test_dose_response_uses_columns_with_both_levels(spark):
    rows = [("a", 1, 1.0), ("a", 5, 2.0), ("b", 1, 1.0), ("b", 5, 4.0), ("c", 1, 7.0), ("d", 3, 1.0)]
    df = spark.createDataFrame(rows, "column string, level int, z double")
    row = P.dose_response(df, ["column"], "z").first()
    assert (row["n"], row["mean"]) == (2, 2.0) and row["t"] == pytest.approx(2.0)
    assert row["p"] == pytest.approx(0.295167, abs=1e-5)


def test_census_counts_in_order(pairs):
    rows = P.selection_census(pairs, {"all": F.lit(True), "dz <= -2.0": F.col("dz_cv") <= -2.0}).orderBy("step").collect()
    assert [(r["condition"], r["remaining"]) for r in rows] == [("all", 5), ("dz <= -2.0", 2)]


def test_one_per_question_then_the_strongest(pairs):
    best = P.strongest_per_question(pairs, "question", "dz_cv", "id").collect()
    assert [(r["question"], r["id"]) for r in best] == [("q2", "c"), ("q1", "b")]
    assert len(P.strongest_per_question(pairs, "question", "dz_cv", "id", size=1).collect()) == 1


def test_requests_matched_by_text(spark):
    prompts = spark.createDataFrame(
        [("r1", "one  two\n three "), ("r2", "other"), ("r3", "one two three"), ("r4", None)], "request_id string, prompt string"
    )
    pack = spark.createDataFrame(
        [("p1", "one two three", 0), ("p2", " one two\tthree", 1), ("p3", "unsent", 2)], "prompt_id string, prompt string, position int"
    )
    mapping = R.request_by_text(prompts, pack)
    assert {tuple(r) for r in mapping.collect()} == {("r1", "p2"), ("r3", "p2")}
    rows = spark.createDataFrame([("r1", 1.0), ("r2", 2.0), ("r3", 3.0)], "request_id string, std double")
    assert {tuple(r) for r in R.restamp(rows, mapping).collect()} == {("p2", 1.0), ("p2", 3.0)}


@pytest.mark.parametrize("sent,ok,dry,want", [
    (0, 0, True, "dry_run"), (5, 0, False, "none_answered"), (5, 3, False, "partly_answered"),
    (5, 5, False, "answered_not_recorded"),
])
def test_outcomes(spark, sent, ok, dry, want):
    log = spark.createDataFrame([(i < ok,) for i in range(sent)], "ok boolean")
    row = R.send_outcome(log, dry_run=dry).first()
    assert (row["n_sent"], row["n_ok"], row["outcome"]) == (sent, ok, want)


def test_padded_window_text(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "2024-01-01 23:59:30")], "a string, b string")
    start, end = R.padded_window(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    assert tuple(df.select(start, end).first()) == ("2023-12-31 23:59:00+0000", "2024-01-02 00:01:30+0000")


def test_first_requests_and_their_prompts(spark):
    requests = spark.createDataFrame([("b",), ("a",), ("c",)], "request_id string")
    prompts = spark.createDataFrame([("a", "x"), ("b", None), ("c", "z")], "request_id string, prompt string")
    first = R.first_requests(requests, 2)
    assert [r[0] for r in first.collect()] == ["a", "b"]
    assert [tuple(r) for r in R.prompts_of(first, prompts).collect()] == [("a", "x")]
