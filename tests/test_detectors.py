import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from profilewatch.operators import detectors as D
from profilewatch.operators import textgate as G
from tests.test_textgate import GOOD

SCHEMA = "i int, text string, vector array<double>"


def nearest(centres):
    """Distance to the nearest of some centres, odd beyond one."""
    def predict(z):
        far = np.sqrt(((z[:, None, :] - centres) ** 2).sum(axis=2)).min(axis=1)
        return {"dist": far, "ood_prob": far / (1 + far), "is_ood": far > 1}

    return predict


def test_a_detector_from_outside_takes_the_manifolds_place(spark):
    rows = [(0, GOOD, [0.0, 0.5]), (1, GOOD, [4.0, 3.0]), (2, "no", [0.0, 0.0]), (3, GOOD, None), (4, GOOD, [5.0, 5.0])]
    foreign = D.Detector(nearest(np.array([[0.0, 0.0], [5.0, 5.0]])), 2)
    got = G.run_gate(spark.createDataFrame(rows, SCHEMA), "text", "vector", foreign).orderBy("i").collect()
    assert [r["is_ood"] for r in got] == [False, True, False, None, False]
    assert [r["gate_ok"] for r in got] == [True, False, False, True, True]
    assert got[0]["ood_dist"] == 0.5 and got[3]["ood_dist"] is None and got[3]["ood_prob"] is None


def test_the_gates_own_limit_counts_too(spark):
    df = spark.createDataFrame([(0, GOOD, [0.0, 0.5])], SCHEMA)
    foreign = D.Detector(nearest(np.zeros((1, 2))), 2)
    assert foreign.score(df, ood_prob_max=0.2).first()["is_ood"] and not foreign.score(df).first()["is_ood"]


def test_another_length_fails_the_job(spark):
    df = spark.createDataFrame([(0, GOOD, [0.0, 0.5, 1.0])], SCHEMA)
    with pytest.raises(PySparkException, match="2 dimensions"):
        D.Detector(nearest(np.zeros((1, 2))), 2).score(df).collect()


@pytest.mark.parametrize("parts", [1, 7, 150])                  # more states than one task unites
def test_parts_are_merged_to_what_one_pass_gives(spark, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1, 2, 0] + 5
    df = spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(x)] + [(999, None, None)], SCHEMA).repartition(parts)
    got = {r["i"]: (r["ood_dist"], r["is_ood"]) for r in D.detector("widest_axis", df, dim=3, limit=2.0).score(df).collect()}
    sd = x.std(axis=0, ddof=1)
    far = np.where(sd > 1e-9, np.abs(x - x.mean(axis=0)) / np.where(sd > 1e-9, sd, 1), 0).max(axis=1)
    assert got.pop(999) == (None, None)
    np.testing.assert_allclose([got[i][0] for i in range(600)], far, rtol=1e-9)
    assert [got[i][1] for i in range(600)] == [bool(f > 2.0 or 1 - np.exp(-f * f / 2) > 0.99) for f in far]


def test_names_and_empty_training_sets(spark):
    with pytest.raises(KeyError, match="widest_axis"):
        D.detector("unknown")
    with pytest.raises(ValueError, match="two vectors"):
        D.widest_axis(spark.createDataFrame([], SCHEMA), 2)
    D.register("never", lambda: D.Detector(nearest(np.zeros((1, 2))), 2))
    assert D.detector("never").dim == 2
