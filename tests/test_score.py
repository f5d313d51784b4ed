import math

import pytest

from profilewatch.operators import band as B
from profilewatch.operators import cells as C
from profilewatch.operators import manifold as M
from profilewatch.operators.score import score_batch
from profilewatch.schemas import SCORES
from tests.planted import LIVE, SCOPE, TRAINING, signals
from tests.test_textgate import GOOD


@pytest.fixture(scope="module")
def inputs(spark):
    band = B.fit_band(C.typed_cells(signals(spark, TRAINING), **SCOPE), **SCOPE)
    requests = spark.createDataFrame(
        [("flat", "12345", "yes no " * 40, 11, 64), ("ramp", "p", GOOD, 1, 2), ("short", "p", GOOD, 1, 2),
         ("silent", "p", GOOD, 1, 2)],
        "prompt_id string, prompt string, generated_text string, n_prompt_tokens long, n_generated_tokens long",
    )
    return requests, C.typed_cells(signals(spark, LIVE), **SCOPE), band


def by_id(df):
    return {r["prompt_id"]: r for r in df.collect()}


def test_scores_without_a_manifold(inputs):
    found = score_batch(*inputs, **SCOPE)
    assert found.columns == SCORES.names
    got = by_id(found)
    flat, ramp = got["flat"], got["ramp"]
    assert flat["z_cv"] == pytest.approx(-3 * math.sqrt(0.5)) and flat["flag"] and flat["error"] == ""
    assert flat["n_chars"] == 5 and flat["text_ok"] is False and "distinct-word ratio" in flat["text_reasons"]
    assert ramp["flag"] is False and ramp["text_ok"] and ramp["is_ood"] is None and ramp["ood_prob"] is None


def test_short_requests_keep_a_row_with_an_error_and_no_gate(inputs):
    got = by_id(score_batch(*inputs, **SCOPE))
    for name, used in (("short", 1), ("silent", 0)):
        row = got[name]
        assert row["error"] == f"no profile: Need at least 2 passes with data, got {used}"
        assert row["z_cv"] is None and row["flag"] is None and row["text_ok"] is None and row["n_passes_used"] is None
        assert row["generated_text"] == GOOD


def test_threshold_is_an_argument(inputs):
    assert by_id(score_batch(*inputs, z_cv_max=-3.0, **SCOPE))["flat"]["flag"] is False


def test_scores_with_a_manifold(spark, inputs):
    ring = [(i, [math.cos(i), math.sin(i)]) for i in range(200)]
    model = M.fit_manifold(spark.createDataFrame(ring, "i int, vector array<double>"), mode="full")
    vectors = spark.createDataFrame(
        [("flat", [50.0, 50.0]), ("ramp", [0.0, 0.1]), ("short", [0.0, 0.0])], "request_id string, vector array<double>"
    )
    got = by_id(score_batch(*inputs, vectors, model, **SCOPE))
    assert got["flat"]["is_ood"] is True and got["ramp"]["is_ood"] is False
    assert got["short"]["is_ood"] is None and got["short"]["ood_dist"] is None
