import math

import pytest
from pyspark.sql import functions as F

from profilewatch.operators import band as B
from profilewatch.operators import cells as C
from profilewatch.operators import panel
from profilewatch.operators import profile as P
from profilewatch.sources import snapshot
from tests.planted import LIVE, RAMP, SCOPE, STEEP, TRAINING, signals

#: cv of [1,2,3] is sqrt(2/3)/2, of [3,4,5] half of that; two points, sample sd = gap / sqrt(2)
CV1 = math.sqrt(2 / 3) / 2
CV_MEAN, CV_SD = 0.75 * CV1, (CV1 / 2) / math.sqrt(2)
Z_RAMP, Z_FLAT = math.sqrt(0.5), -3 * math.sqrt(0.5)


def cells_of(spark, grids):
    return C.typed_cells(signals(spark, grids), **SCOPE)


@pytest.fixture(scope="module")
def band(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("band"))
    B.fit_band(cells_of(spark, TRAINING), version="test", **SCOPE).save(path)
    return B.load_band(spark, path)


def stats(spark, grids, band=None, **kw):
    found = P.request_statistics(cells_of(spark, grids), band, **SCOPE, **kw)
    return {r["request_id"]: r for r in found.collect()}


def test_band_of_two_requests(band):
    row = band.frame.first()
    assert row["cv_mean"] == pytest.approx(CV_MEAN) and row["cv_sd"] == pytest.approx(CV_SD)
    assert (row["slope_mean"], row["slope_sd"], row["n_requests"], row["version"]) == (1.0, 0.0, 2, "test")
    assert row["profile_mean"] == [2.0, 3.0, 4.0]
    assert row["profile_sd"] == pytest.approx([math.sqrt(2)] * 3)
    assert row["layers"] == [0, 1, 2] and row["passes"] == [2, 3]
    wide = band.range().first()
    assert wide["cv_low"] == pytest.approx(CV_MEAN - 3 * CV_SD)


def test_band_needs_two_complete_requests(spark):
    one = {"a": TRAINING["a"], "partial": {2: RAMP, 3: [1.0, 2.0]}}
    with pytest.raises(Exception, match="at least 2 requests"):
        B.fit_band(cells_of(spark, one), **SCOPE).frame.collect()
    for part in (lambda b: b.layer(), lambda b: b.range(), lambda b: b.frame.select("version"), lambda b: spark.range(1).select(b.row())):
        with pytest.raises(Exception, match="at least 2 requests"):
            part(B.fit_band(cells_of(spark, one), **SCOPE)).collect()


def test_a_named_request_with_too_few_passes_fails_the_fit(spark):
    named = spark.createDataFrame([("ramp",), ("flat",), ("short",)], "request_id string")
    with pytest.raises(Exception, match="at least 2 passes"):
        B.fit_band(cells_of(spark, LIVE), named, **SCOPE).frame.collect()
    gone = spark.createDataFrame([("ramp",), ("flat",), ("nobody",)], "request_id string")
    with pytest.raises(Exception, match="has no rows"):
        B.fit_band(cells_of(spark, LIVE), gone, **SCOPE).layer().collect()


def test_flat_ramp_and_short(spark, band):
    got = stats(spark, {**LIVE, "outside": {9: RAMP}}, band, arrays=True)
    flat, ramp = got["flat"], got["ramp"]
    assert (flat["cv"], flat["slope"], flat["corr"], flat["z_slope"]) == (0.0, 0.0, 0.0, 0.0)
    assert flat["z_cv"] == pytest.approx(Z_FLAT)
    assert flat["z_by_layer"] == pytest.approx([0.0, -math.sqrt(0.5), -math.sqrt(2)])
    assert flat["max_abs_z_layer"] == pytest.approx(math.sqrt(2))
    assert flat["cv_by_pass"] == [0.0, 0.0] and flat["cv_pass_slope"] == 0.0 and flat["n_passes_used"] == 2
    assert ramp["corr"] == pytest.approx(1.0) and ramp["z_cv"] == pytest.approx(Z_RAMP)
    assert ramp["profile"] == RAMP
    assert got["short"]["cv"] is None and got["short"]["n_passes_used"] == 1
    assert got["outside"]["n_passes_used"] == 0


def test_missing_cells_are_left_out_of_the_mean(spark):
    grids = {"r": {2: [1.0, 2.0, 3.0], 3: [3.0, float("nan"), 5.0]}}
    rows = P.layer_profiles(cells_of(spark, grids)).orderBy("layer").collect()
    assert [r["v"] for r in rows] == [2.0, 2.0, 4.0]
    assert stats(spark, grids)["r"]["n_passes_used"] == 2
    gap = {"r": {2: RAMP, 3: [float("nan")] * 3}}
    assert stats(spark, gap)["r"]["n_passes_used"] == 1
    assert stats(spark, gap, min_passes=1)["r"]["cv"] == pytest.approx(CV1)
    by_pass = P.variation_by_pass(cells_of(spark, gap)).collect()
    assert [(r["pass"], r["cv"]) for r in by_pass] == [(2, pytest.approx(CV1))]


def test_variation_ignores_scale_and_survives_zero(spark):
    got = stats(spark, {
        "r": {2: RAMP, 3: RAMP}, "big": {p: [17 * x for x in RAMP] for p in (2, 3)},
        "zero": {p: [0.0] * 3 for p in (2, 3)}, "mirror": {p: [-1.0, 0.0, 1.0] for p in (2, 3)},
        "endless": {p: [1.0, 2.0, float("inf")] for p in (2, 3)},
    })
    assert got["big"]["cv"] == pytest.approx(got["r"]["cv"])
    assert got["zero"]["cv"] == 0.0 and got["mirror"]["cv"] == 0.0 and got["endless"]["cv"] == 0.0
    assert got["endless"]["slope"] == pytest.approx(1.0)


def test_pass_trend_uses_positions_not_pass_numbers(spark):
    scope = {"layers": (0, 1), "passes": (2, 5)}
    cells = C.typed_cells(signals(spark, {"r": {2: [1.0, 1.0], 5: [1.0, 3.0]}}), **scope)
    # cv goes from 0 to 0.5 over one position
    assert P.request_statistics(cells, **scope).first()["cv_pass_slope"] == pytest.approx(0.5)


def test_complete_requests(spark):
    grids = {**TRAINING, "short": {2: RAMP}, "holey": {2: RAMP, 3: RAMP[:2]}}
    got = B.complete_requests(cells_of(spark, grids), **SCOPE)
    assert sorted(r[0] for r in got.collect()) == ["a", "b"]


def test_summary_histogram_and_threshold(spark, band):
    scores = panel.read_request_scores(cells_of(spark, LIVE), band, **SCOPE)
    row = panel.window_summary(scores, band).first()
    assert (row["sample_count"], row["flattened_rate"], row["healthy_rate"], row["n_incomplete"]) == (2, 0.5, 0.5, 1)
    assert row["mean_cv"] == pytest.approx(CV1 / 2) and row["mean_corr"] == pytest.approx(0.5)
    assert row["mean_z_cv"] == pytest.approx((Z_RAMP + Z_FLAT) / 2)
    assert row["reference_n_requests"] == 2

    bands = panel.score_distribution(scores, n_bands=4).orderBy("band").collect()
    assert [b["count"] for b in bands] == [1, 0, 0, 1]
    assert bands[0]["lower"] == pytest.approx(Z_FLAT) and bands[-1]["upper"] == pytest.approx(Z_RAMP)
    assert sum(b["fraction"] for b in bands) == 1.0

    flags = {r["request_id"]: r["is_flattened"] for r in panel.scored_only(scores).collect()}
    assert flags == {"flat": True, "ramp": False}
    strict = panel.read_request_scores(cells_of(spark, LIVE), band, z_cv_max=-3.0, **SCOPE)
    assert not any(r["is_flattened"] for r in panel.scored_only(strict).collect())


def test_threshold_is_inclusive(spark):
    got = spark.range(1).select(P.is_flattened(F.lit(-2.0)), P.is_flattened(F.lit(-1.999))).first()
    assert tuple(got) == (True, False)


def test_empty_window_and_equal_scores(spark, band):
    scores = panel.read_request_scores(cells_of(spark, LIVE), band, **SCOPE)
    row = panel.window_summary(scores.filter("false"), band).first()
    assert (row["sample_count"], row["flattened_rate"], row["healthy_rate"]) == (0, 0.0, 1.0)
    assert row["reference_cv_mean"] == pytest.approx(CV_MEAN)
    assert panel.score_distribution(scores.filter("false")).collect() == []

    twins = panel.read_request_scores(cells_of(spark, {"x": LIVE["ramp"], "y": LIVE["ramp"]}), band, **SCOPE)
    only = panel.score_distribution(twins).collect()
    assert [(b["count"], b["fraction"]) for b in only] == [(2, 1.0)]


def test_layers_without_width_have_no_z(spark):
    same = {"a": TRAINING["a"], "b": TRAINING["a"]}
    narrow = B.fit_band(cells_of(spark, same), **SCOPE)
    got = stats(spark, {"s": {2: STEEP, 3: STEEP}}, narrow, arrays=True)["s"]
    assert got["z_by_layer"] == [0.0, 0.0, 0.0] and got["z_cv"] == 0.0 and got["max_abs_z_layer"] == 0.0


def test_census_and_description(spark):
    rows = signals(spark, {**TRAINING, "short": {2: RAMP}})
    prompts = spark.createDataFrame([("a",), ("b",), ("silent",), ("short",)], "request_id string")
    got = snapshot.census(prompts, rows, **SCOPE).first().asDict()
    assert got == {"n_requests": 4, "n_requests_with_signals": 3, "n_requests_complete": 2,
                   "n_signal_types": 3, "n_scalar_rows": 15}
    text = snapshot.capture_description(rows).first()
    assert text["n_rows"] == 15 and text["signal_types"] == sorted(text["signal_types"])
    assert snapshot.census(prompts, rows.filter("false"), **SCOPE).first()["n_scalar_rows"] == 0
