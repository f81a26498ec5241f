"""Queries train their models in the sizes of the usual experiments."""

import pytest

from pourstat.operators import boost as B
from pourstat.operators import surrogates as U
from pourstat.workload import learning_queries as Q
from pourstat.workload.registry import REGISTRY


@pytest.fixture
def frames(monkeypatch):
    """Queries without tables: only what they ask of the models is looked at."""
    monkeypatch.setattr(Q, "rows", lambda t: None)
    monkeypatch.setattr(Q, "recipes", lambda t: None)
    monkeypatch.setattr(Q, "durable", lambda df: df)
    monkeypatch.setattr(Q.P, "fold_roles", lambda *a: None)
    monkeypatch.setattr(Q.M, "regression_metrics", lambda out, keys: out)


def test_holdout_regression_has_whole_ensembles(spark, frames, monkeypatch):
    monkeypatch.setattr(Q.L, "holdout", lambda rows, sets, specs: specs)
    specs = REGISTRY["mod06_07_10_holdout_regression"].run(spark, "")
    forest, boosting = (specs[m].build(100, 1.0) for m in ("RandomForest", "GradientBoosting"))
    assert (forest.getNumTrees(), forest.getMaxDepth(), boosting.getMaxIter()) == (300, 12, 300)


def _passed(monkeypatch, module, name, answer):
    """Parameters of a call, defaults included."""
    import inspect

    real, seen = getattr(module, name), {}

    def stub(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return answer

    monkeypatch.setattr(module, name, stub)
    return seen


class _Scores:
    def withColumnRenamed(self, *a):
        return self


def test_holdout_boosting_has_all_rounds(spark, frames, monkeypatch):
    monkeypatch.setattr(Q.L, "holdout_rows", lambda *a: None)
    seen = _passed(monkeypatch, Q.B, "boost", (_Scores(), None, None))
    REGISTRY["mod07_10_holdout_boosting"].run(spark, "")
    assert seen["params"] == B.BoostParams(rounds=300, rate=0.05, leaves=31) and len(seen["feature_sets"]) == 4


def test_surrogates_have_all_rounds_and_trees(spark, frames, monkeypatch):
    seen = _passed(monkeypatch, Q.U, "train", (None, None))
    REGISTRY["mod12_mix_surrogates"].run(spark, "")
    assert seen["boosting"] == B.BoostParams(rounds=300, rate=0.06) and seen["forest"] == B.ForestParams(trees=300, depth=12)
    assert seen["targets"] == U.TARGETS
