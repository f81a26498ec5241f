"""What the tasks, stages and metrics of an experiment share is made once."""

import pytest

from pourstat.operators import metrics as M
from pourstat.workload import learning_queries as Q
from pourstat.workload.registry import REGISTRY


@pytest.fixture
def packs(spark, monkeypatch):
    """Model frames that were packed, for queries whose frames and predictions are stand-ins."""
    made = []
    predictions = {
        False: spark.createDataFrame([("s", "DummyMean", 1, 2.0, 3.0, 2000)], f"Stage string, Model string, testId int, {M.ACTUAL} double, {M.PREDICTED} double, ExternalValidationYear int"),
        True: spark.createDataFrame([("s", "DummyPrior", 1, 1, 0.5, 2000)], f"Stage string, Model string, testId int, {M.FAILED} int, {M.SCORE} double, ExternalValidationYear int"),
    }

    def evaluate(rows, classify, keep=(), packed=None):
        assert packed == "frames"
        return predictions[classify]

    monkeypatch.setattr(Q.Tables, "__getitem__", lambda self, name: None)
    monkeypatch.setattr(Q.V, "scenario_rows", lambda facts: None)
    monkeypatch.setattr(Q.V, "unseen_roles", lambda rows, scenario, seed: scenario)
    monkeypatch.setattr(Q.V, "external_roles", lambda *a: "external")
    monkeypatch.setattr(Q.V, "frames", lambda rows, keep=(): made.append(rows) or "frames")
    monkeypatch.setattr(Q.V, "evaluate", evaluate)
    return made


def test_unseen_groups_pack_once_for_both_tasks(spark, packs):
    tasks = {r.Task for r in REGISTRY["mod11_unseen_groups"].run(spark, "").collect()}
    assert tasks == {"Regression", "Classification"} and packs == list(Q.V.UNSEEN)


def test_external_baselines_pack_once_for_both_tasks(spark, packs):
    rows = REGISTRY["mod11_external_baselines"].run(spark, "").collect()
    assert {r.Model for r in rows} == {"DummyMean", "DummyPrior"} and packs == ["external"]


def test_unseen_baselines_pack_once_for_both_tasks(spark, packs):
    rows = REGISTRY["mod11_unseen_baselines"].run(spark, "").collect()
    assert {(r.Model, r.Scenario) for r in rows} == {(m, s) for m in ("DummyMean", "DummyPrior") for s in Q.V.UNSEEN}
    assert packs == list(Q.V.UNSEEN)


def test_cross_validation_metrics_read_stored_predictions(spark, monkeypatch):
    made = spark.createDataFrame([("f", "m", 1, 2.0, 3.0, 7)], f"FeatureSet string, Model string, Fold int, {M.ACTUAL} double, {M.PREDICTED} double, testId int")
    monkeypatch.setattr(Q, "rows", lambda t: None)
    monkeypatch.setattr(Q.G, "cross_validate_linear", lambda rows, sets: made)
    monkeypatch.setattr(Q.M, "regression_metrics", lambda out, keys: out)
    out = REGISTRY["mod04_09_regression_cross_validation"].run(spark, "")
    assert out.inputFiles() and "testId" not in out.columns and out.count() == 1
