import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilewatch.functions import distributions as D
from profilewatch.operators import manifold as M
from profilewatch.operators import vectors as V
from profilewatch.operators.quantiles import exact_quantiles
from tests.planted import EMBED, LAYER


def frame(spark, x):
    return spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, vector array<double>"
    )


def by_hand(train, rows, shrinkage, k=None, diagonal=False):
    """Centre, project, shrink, invert -- in numpy, for comparison."""
    mean = train.mean(axis=0)
    axes = np.linalg.svd(train - mean, full_matrices=False)[2][:k] if k else np.eye(train.shape[1])
    z, live = (train - mean) @ axes.T, (rows - mean) @ axes.T
    cov = np.cov(z, rowvar=False)
    d = cov.shape[0]
    inv = np.linalg.inv((1 - shrinkage) * cov + shrinkage * np.trace(cov) / d * np.eye(d))
    if diagonal:
        inv = np.diag(np.diag(inv))
    return [np.sqrt(np.einsum("ni,ij,nj->n", x, inv, x)) for x in (z, live)]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(11)
    mix = rng.normal(size=(12, 12))
    return rng.normal(size=(300, 12)) @ mix, rng.normal(size=(40, 12)) @ mix * 2 + 1


@pytest.mark.parametrize("mode,k", [("pca", 5), ("full", None), ("diagonal", None)])
def test_distances_equal_numpy(spark, cloud, tmp_path, mode, k):
    train, live = cloud
    model = M.fit_manifold(frame(spark, train), mode=mode, pca_k=5)
    want_train, want = by_hand(train, live, 0.1, k, mode == "diagonal")
    model.save(str(tmp_path / "m"))
    again = M.load_manifold(spark, str(tmp_path / "m"))
    got = [r["ood_dist"] for r in again.score(frame(spark, live)).orderBy("i").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)
    assert model.threshold == pytest.approx(np.quantile(want_train, 0.99), rel=1e-9)
    assert again.spread[0.95] == pytest.approx(np.quantile(want_train, 0.95), rel=1e-9)
    assert again.n_train == 300 and again.k == (k or 12)


def test_centre_in_far_point_out_and_stricter_gate(spark):
    rng = np.random.default_rng(0)
    model = M.fit_manifold(frame(spark, rng.normal(size=(400, 2))), mode="full", shrinkage=0.01)
    points = frame(spark, [[0.0, 0.0], [12.0, -12.0], [2.0, 2.0]])
    centre, far, edge = model.score(points).orderBy("i").collect()
    assert not centre["is_ood"] and centre["ood_prob"] < 0.05
    assert far["is_ood"] and far["ood_prob"] == pytest.approx(1.0)
    assert not edge["is_ood"]
    assert model.score(points, ood_prob_max=0.5).filter("i = 2").first()["is_ood"]


def test_missing_vector_has_no_verdict_and_wrong_width_fails(spark, cloud):
    model = M.fit_manifold(frame(spark, cloud[0]), pca_k=4)
    gap = spark.createDataFrame([(1, None)], "i int, vector array<double>")
    row = model.score(gap).first()
    assert row["ood_dist"] is None and row["ood_prob"] is None and row["is_ood"] is None
    with pytest.raises(Exception, match="12 dimensions"):
        model.score(frame(spark, [[1.0, 2.0]])).collect()


def test_small_samples_are_guarded(spark):
    assert (M.safe_k(48, 768, 32), M.safe_k(10, 768, 32), M.safe_k(3, 768, 32), M.safe_k(99, 4, 32)) == (32, 8, 2, 4)
    assert M.safe_shrinkage(65, 32, 0.1) == 0.1 and M.safe_shrinkage(64, 32, 0.1) == 0.3
    assert M.safe_shrinkage(64, 32, 0.5) == 0.5
    with pytest.raises(ValueError, match="at least 2"):
        M.fit_manifold(frame(spark, [[1.0, 2.0]]))
    with pytest.raises(ValueError, match="samples"):
        M.fit_manifold(frame(spark, np.eye(3)))


def test_training_vectors_that_do_not_vary_are_refused(spark):
    for mode in M.MODES:
        with pytest.raises(ValueError, match="do not vary"):
            M.fit_manifold(frame(spark, [[1.0, 2.0, 3.0]] * 9), mode=mode, pca_k=2)


def test_five_scalars_by_hand(spark):
    # of the kept 0.25, -1, 0, 3: mean 9/16, squares 10.0625
    df = spark.createDataFrame([([0.25, -1.0, 0.0, 3.0, 7.5],)], "v array<float>")
    from profilewatch.functions.vectors import leading_dims

    row = df.select(*V.scalar_columns(leading_dims(F.col("v"), 4))).first()
    assert row["mean"] == 0.5625 and row["sparsity"] == 0.25 and row["saturation"] == 0.5
    assert row["norm"] == pytest.approx(math.sqrt(10.0625))
    assert row["std"] == pytest.approx(math.sqrt(10.0625 / 4 - 0.5625**2))
    edge = spark.createDataFrame([([0.95, 0.951, 1e-12, 0.0],)], "v array<double>")
    row = edge.select(*V.scalar_columns(F.col("v"))).first()
    assert row["saturation"] == 0.25 and row["sparsity"] == 0.25
    with pytest.raises(Exception, match="empty vector"):
        spark.createDataFrame([([],)], "v array<double>").select(*V.scalar_columns(F.col("v"))).collect()


def test_arrow_scalars_equal_the_native_ones(spark):
    from profilewatch.functions.vectors import vector_scalars_arrow

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.where(rng.random(n) < 0.2, 0.0, rng.normal(size=n))])
            for i, n in enumerate([1, 7, 7, 64, 33, 64])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    native = df.select("i", *V.scalar_columns(F.col("v"))).orderBy("i").collect()
    arrow = df.withColumn("s", vector_scalars_arrow(F.col("v"))).select("i", "s.*").orderBy("i").collect()
    np.testing.assert_allclose(np.array(arrow), np.array(native), rtol=1e-12, atol=1e-15)
    with pytest.raises(Exception, match="empty vector"):
        spark.createDataFrame([([],)], "v array<float>").select(vector_scalars_arrow(F.col("v"))).collect()


def test_positions_average_for_the_embedding_and_take_the_first_otherwise(spark):
    rows = [("r", s, str(p), pos, [float(pos), 1.0, 2.0 * pos]) for s in (EMBED, LAYER + "0") for p in (1, 9)
            for pos in (2, 0, 1)]
    df = spark.createDataFrame(rows, "request_id string, signal_type string, forward_pass_index string, position int, vector array<float>")
    got = {(r["signal_type"], r["forward_pass_index"]): r for r in V.reduce_positions(df).collect()}
    assert got[(EMBED, "1")]["vector"] == [1.0, 1.0, 2.0] and got[(EMBED, "1")]["n_positions"] == 3
    assert got[(LAYER + "0", "1")]["vector"] == [0.0, 1.0, 0.0]
    captured = V.capture_rows(df, keep_dims=2)
    assert {r["forward_pass_index"] for r in captured.collect()} == {"1"}
    assert captured.filter(F.col("signal_type") == EMBED).first()["dim"] == 3
    forced = V.reduce_positions(df, F.lit("first"))
    assert forced.filter(F.col("signal_type") == EMBED).first()["vector"][0] == 0.0


def test_reference_vector_takes_the_numerically_highest_pass(spark):
    rows = [("r", LAYER + "14", "8", [8.0]), ("r", LAYER + "14", "10", [10.0]), ("r", LAYER + "3", "12", [99.0]),
            ("p", LAYER + "14", "1", [1.0])]
    df = spark.createDataFrame(rows, "request_id string, signal_type string, forward_pass_index string, vector array<double>")
    got = {r[0]: r[1] for r in V.reference_vectors(df).collect()}
    assert got == {"r": [10.0], "p": [1.0]}
    assert {r[0] for r in V.reference_vectors(df, min_pass=2).collect()} == {"r"}


@pytest.mark.parametrize("values", [
    list(np.random.default_rng(1).normal(size=5000)),
    [1.0] * 900 + list(range(100)),          # one value holds most rows
    [float(i) for i in range(7)],
    [3.5],
])
@pytest.mark.parametrize("ranked", [1_000_000, 3])              # few rows in one task: brackets are sketched again
def test_quantiles_equal_numpy(spark, monkeypatch, values, ranked):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ps = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    monkeypatch.setattr("profilewatch.operators.quantiles._RANKED", ranked)
    np.testing.assert_allclose(exact_quantiles(df, "x", ps), np.quantile(values, ps), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def chi_by_integration(x, df, steps=200_000):
    t = np.linspace(0, math.sqrt(x), steps + 1)          # t^2 as variable, no pole at 0
    f = 2 * t ** (df - 1) * np.exp(-t * t / 2)
    return np.trapezoid(f, t) / (2 ** (df / 2) * math.gamma(df / 2))


@pytest.mark.parametrize("df", [1, 2, 3, 5, 16, 31, 32, 64])
def test_chi_square_against_integration(spark, df):
    xs = [0.0, 0.3, 2.0, 9.5, 31.0, 70.0, 200.0, 1e6]
    frame_ = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in frame_.select(D.chi_square_cdf(F.col("x"), df)).collect()]
    want = [0.0] + [chi_by_integration(x, df) for x in xs[1:-1]] + [1.0]
    np.testing.assert_allclose(got, want, atol=2e-9)


def test_chi_square_of_a_wide_space_and_null(spark):
    row = spark.range(1).select(
        D.chi_square_cdf(F.lit(768.0), 768), D.chi_square_cdf(F.lit(None).cast("double"), 4)
    ).first()
    assert 0.5 < row[0] < 0.52 and row[1] is None


def t_by_integration(t, df, steps=400_000):
    u = np.linspace(0, math.atan(t / math.sqrt(df)), steps + 1)
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 1 - 2 * const * np.trapezoid(np.cos(u) ** (df - 1), u)


@pytest.mark.parametrize("df", [1, 2, 3, 4, 10, 44, 45, 399, 400, 401, 1000, 100_000])
def test_student_t_against_integration(spark, df):
    ts = [0.0, 0.1, 1.0, 2.23, 3.29, 6.53]
    frame_ = spark.createDataFrame([(t,) for t in ts], "t double")
    got = [r[0] for r in frame_.select(D.t_two_sided(F.col("t"), F.lit(df))).collect()]
    np.testing.assert_allclose(got, [t_by_integration(t, df) for t in ts], atol=5e-9)


def test_published_t_value(spark):
    # any number of pairs, and small tails with all their digits: t = 2, df large is the normal 0.0455;
    # df 2 has the closed form 1 - t / sqrt(2 + t^2)
    big = spark.range(1).select(D.t_two_sided(F.lit(2.0), F.lit(3_000_000_000))).first()[0]
    assert big == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-8)
    two = spark.range(1).select(D.t_two_sided(F.lit(1e4), F.lit(2))).first()[0]
    assert two == pytest.approx(2 / (2 + 1e8) / (1 + 1e4 / math.sqrt(2 + 1e8)), rel=1e-9)
    tail = spark.range(1).select(D.t_two_sided(F.lit(12.0), F.lit(401))).first()[0]
    assert 1e-29 < tail < 1e-27
    p = spark.range(1).select(D.t_two_sided(F.lit(-3.29), F.lit(44))).first()[0]
    assert round(p, 4) == 0.0020
    assert spark.range(1).select(D.t_two_sided(F.lit(1.0), F.lit(0))).first()[0] is None
