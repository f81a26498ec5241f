"""Surrogates, the recipe search, validation scenarios and comparison tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.operators import boost as B
from pourstat.operators import decide as D
from pourstat.operators import metrics as M
from pourstat.operators import scenarios as V
from pourstat.operators import surrogates as U

RECIPE = S.RECIPE_CORE
QUICK = B.BoostParams(rounds=6, rate=0.3, min_leaf=5)
FEW = B.ForestParams(trees=8, depth=6)


def recipe_table(n=360):
    rnd = random.Random(3)
    out = []
    for i in range(n):
        cement, ash, wc = 300.0 + 10 * rnd.randrange(40), 10.0 * rnd.randrange(5), 0.35 + 0.01 * rnd.randrange(30)
        y = 1500 + 6 * cement - 1500 * wc + rnd.gauss(0, 80)
        slump = 2 + 10 * (wc - 0.35) + rnd.gauss(0, 0.1)
        air = rnd.gauss(5, 1) if i < 60 else None
        out.append((i, "test" if i % 4 == 0 else "train", f"S{i % 3}", f"{i % 2}", cement, ash, wc, 1000.0, 1800.0, None if i % 9 == 0 else 3.0, cement + ash, y, slump, air))
    return out + [(n + k, "train", "S0", "0", *out[1][4:]) for k in range(5)]


@pytest.fixture(scope="module")
def recipes(spark):
    names = ", ".join(f"{c} double" for c in [*RECIPE, "WaterAdded_gal_per_yd3", "TotalCementitiousContent_lbs_yd3", S.TARGET, "EffectiveSlump_in", "EffectiveAir_percent"])
    return spark.createDataFrame(recipe_table(), f"testId int, Role string, SupplierName string, plantNumber string, {names}").cache()


@pytest.fixture(scope="module")
def trained(recipes):
    return U.train(recipes, boosting=QUICK, forest=FEW)


def test_surrogates(trained, recipes):
    table, best = trained
    rows = {(r.TargetKey, r.Model): r for r in table.collect()}
    assert set(rows) == {(k, m) for k in ("strength28", "slump") for m in ("DummyMedian", "HistGradientBoosting", "ExtraTrees")} | {("air", "Skipped")}
    assert rows["air", "Skipped"].TrainRows == 45 + 5 and rows["air", "Skipped"].MAE is None
    for key in ("strength28", "slump"):
        marked = [m for (k, m), r in rows.items() if k == key and r.IsBest]
        assert marked == [best[key].model_name] and marked[0] != "DummyMedian"
        assert best[key].mae == min(rows[key, m].MAE for m in ("HistGradientBoosting", "ExtraTrees"))
        assert best[key].r2 > 0.5 and rows[key, "DummyMedian"].R2 < 0.1
    data = recipe_table()
    median = np.median([r[11] for r in data if r[1] == "train"])
    test = np.array([r[11] for r in data if r[1] == "test"])
    assert rows["strength28", "DummyMedian"].MAE == pytest.approx(np.abs(test - median).mean())
    assert "air" not in best


@pytest.mark.parametrize("objective, column", [("cement", "CalcCementContent_lbs_yd3"), ("total_cementitious", "TotalCementitiousContent_lbs_yd3")])
def test_search_ranks_distinct_recipes(trained, recipes, objective, column):
    _, best = trained
    search = U.Search(required=3000.0, safety_margin=100.0, supplier="S0", wc_max=0.6, slump=(2.5, 4.0), objective=objective, top=10)
    found = U.find_recipes(recipes, best, search).collect()
    assert 0 < len(found) <= 10 and len({tuple(r[c] for c in best["strength28"].features if c in recipes.columns) for r in found}) == len(found)
    assert [r[column] for r in found] == sorted(r[column] for r in found)
    for r in found:
        assert r.SupplierName == "S0" and r.calcWCRatio <= 0.6 and 2.5 <= r.PredictedSlump_in <= 4.0
        assert r.ConservativeStrength28_psi == pytest.approx(r.PredictedStrength28_psi - best["strength28"].p90_error) and r.ConservativeStrength28_psi >= 3100


def test_search_guards(trained, recipes):
    _, best = trained
    weak = {**best, "strength28": U.Surrogate(S.TARGET, "m", ("x",), None, 0.05, 1.0, 1.0)}
    with pytest.raises(ValueError, match="R2 of strength"):
        U.find_recipes(recipes, weak)
    with pytest.raises(ValueError, match="air limits need"):
        U.find_recipes(recipes, best, U.Search(air=(4.0, None)))
    with pytest.raises(ValueError, match="R2 of slump"):
        U.find_recipes(recipes, {**best, "slump": U.Surrogate("s", "m", ("x",), None, 0.0, 1.0, 1.0)}, U.Search(slump=(1.0, None)))
    with pytest.raises(ValueError, match="no historical recipes"):
        U.find_recipes(recipes, best, U.Search(supplier="nobody"))
    with pytest.raises(ValueError, match="objective"):
        U.find_recipes(recipes, best, U.Search(objective="carbon"))
    with pytest.raises(ValueError, match="strength surrogate"):
        U.find_recipes(recipes, {})


@pytest.fixture(scope="module")
def facts(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(700):
        year = 1996 + rnd.randrange(6)
        supplier = None if rnd.random() < 0.1 else f"S{rnd.randrange(12)}"
        y = 4000 + 300 * (int(supplier[1:]) % 3 if supplier else 0) + rnd.gauss(0, 300)
        day7 = None if rnd.random() < 0.3 else 0.7 * y + rnd.gauss(0, 50)
        rows.append((i, i % 40, f"{year}-05-01", supplier, f"0{i % 3}", f"M{i % 4}", y, 4200.0, day7, 2, *[rnd.uniform(0, 10) for _ in S.FIELD_FEATURES]))
    ddl = f"testId int, projectId int, castDate string, SupplierName string, plantNumber string, mixNumber string, {S.TARGET} double, {S.REQUIRED} double, {S.DAY7} double, {S.DAY7_COUNT} int, "
    return spark.createDataFrame(rows, ddl + ", ".join(f"{c} double" for c in S.FIELD_FEATURES)).withColumn("castDate", F.to_date("castDate")).cache()


def test_stages_choose_their_own_rows(facts):
    rows = V.external_roles(V.labelled_rows(facts), 1998, 1999, 2001)
    out = V.evaluate(rows, False, ["ExternalValidationYear"], boosting=B.BoostParams(rounds=3)).collect()
    data = rows.collect()
    test = [r for r in data if r.Role == "test"]
    for stage, kept in (("Day0_Context", test), ("Day7_FullUpdated", [r for r in test if r[S.DAY7] is not None])):
        for model in ("DummyMean", "DummyMedian", "Ridge", "HistGradientBoosting"):
            got = {r.testId: r for r in out if r.Stage == stage and r.Model == model}
            assert set(got) == {r.testId for r in kept} and len(kept) > 100
            assert all(got[r.testId][M.ACTUAL] == r[S.TARGET] and got[r.testId].ExternalValidationYear == r.castDate.year for r in kept)
        train = [r[S.TARGET] for r in data if r.Role == "train" and (stage == "Day0_Context" or r[S.DAY7] is not None)]
        assert {round(r[M.PREDICTED], 6) for r in out if r.Stage == stage and r.Model == "DummyMean"} == {round(float(np.mean(train)), 6)}
    error = {m: np.mean([abs(r[M.PREDICTED] - r[M.ACTUAL]) for r in out if r.Stage == "Day7_FullUpdated" and r.Model == m]) for m in ("DummyMean", "Ridge")}
    assert error["Ridge"] < 0.5 * error["DummyMean"]


def test_classification_stages(facts):
    rows = V.external_roles(V.labelled_rows(facts), 1998, 1999, 2001)
    out = V.evaluate(rows, True, boosting=B.BoostParams(rounds=3))
    table = {(r.Stage, r.Model): r for r in V.metrics(out, True, ["Stage", "Model"]).collect()}
    assert set(table) == {(s.name, m) for s in V.stages() for m in ("DummyPrior", "LogisticRegression", "HistGradientBoosting")}
    assert all(0.85 < table["Day7_FullUpdated", m].ROC_AUC for m in ("LogisticRegression", "HistGradientBoosting"))


def test_unseen_groups_are_disjoint(facts):
    rows = V.labelled_rows(facts)
    for scenario in V.UNSEEN:
        roles = V.unseen_roles(rows, scenario, test_percent=50)
        s = V.split_summary(rows, roles, scenario).first()
        assert s.OverlappingGroups == 0 and s.TrainRows + s.TestRows == s.RowsAfterContextFilter
        assert s.RowsExcludedForMissingContext == 700 - s.RowsAfterContextFilter > 0 and s.TestGroups > 0


def test_external_rows_with_a_shared_id_raise(facts):
    rows = V.labelled_rows(facts)
    twice = rows.unionByName(rows.withColumn("castDate", F.to_date(F.lit("2000-01-01"))))
    with pytest.raises(ValueError, match="both sides"):
        V.external_roles(twice, 1998, 1999, 2001)


def test_effects_need_one_result_per_side(frame):
    results = frame([("a", "m", 1.0), ("b", "m", 3.0), ("b", "m", 4.0), ("c", "m", 9.0)], "Experiment string, Model string, R2 double")
    out = D.effects(results, "Experiment", [("step", "a", "c")], ["Model"], ["R2"]).first()
    assert (out.Before_R2, out.After_R2) == (1.0, 9.0)
    with pytest.raises(Exception, match="expected one result"):
        D.effects(results, "Experiment", [("step", "a", "b")], ["Model"], ["R2"]).collect()
    with pytest.raises(Exception, match="expected one result"):
        D.effects(results, "Experiment", [("step", "a", "z")], ["Model"], ["R2"]).collect()


def test_common_rows(frame):
    rows = [("x", "m", 1), ("x", "m", 2), ("y", "m", 2), ("y", "m", 3), ("x", "n", 3), ("z", "n", 3), ("z", "n", 4)]
    df = frame(rows, "FeatureSet string, Model string, testId int")
    assert sorted(map(tuple, D.common_rows(df, "FeatureSet", ["Model"]).select("FeatureSet", "Model", "testId").collect())) == [
        ("x", "m", 2), ("x", "n", 3), ("y", "m", 2), ("z", "n", 3),
    ]


def test_aligned_predictions_need_unique_keys(frame):
    ddl = f"Fold int, FeatureSet string, testId int, {M.PREDICTED} double, RequiredStrength28_psi double"
    regression = frame([(1, "f", 1, 5.0, 4.0), (1, "f", 2, 3.0, 4.0)], ddl)
    one = frame([(1, "f", 1, 0, 0.1), (1, "f", 2, 1, 0.9)], f"Fold int, FeatureSet string, testId int, {M.FAILED} int, {M.SCORE} double")
    assert {r.PredictedMargin_psi for r in D.align_predictions(regression, one).collect()} == {1.0, -1.0}
    with pytest.raises(Exception, match="not unique"):
        D.align_predictions(regression, one.unionByName(one)).collect()
    with pytest.raises(Exception, match="not unique"):
        D.align_predictions(regression.unionByName(regression), one).collect()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_models_go_to_the_predictions(spark, frame):
    ddl = "FeatureSet string, Model string, v int"
    predictions = frame([("a", "A", 1), ("a", "B", 2), ("b", "A", 3), (None, "A", 4)], ddl)
    best = frame([("a", "B"), ("b", "A")], "FeatureSet string, Model string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = D.keep_best_models(predictions, best)
        assert {r.v for r in kept.collect()} == {2, 3}
        assert "hashpartitioning" not in _plan(kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_alignment_sorts_nothing_and_matches_no_null_key(frame):
    ddl = "Fold int, FeatureSet string, testId bigint, PredictedStrength28_psi double, RequiredStrength28_psi double, ActualFailureFlag int, FailureProbability double"
    regression = frame([(1, "f", 1, 5.0, 4.0, 9, 9.0), (1, "f", 2, 3.0, None, 9, 9.0), (1, "f", None, 3.0, 4.0, 9, 9.0), (1, "f", 3, 3.0, 4.0, 9, 9.0)], ddl)
    classification = frame([(1, "f", 1, 0.0, 0.0, 1, 0.5), (1, "f", 2, 0.0, 0.0, None, None), (1, "f", None, 0.0, 0.0, 1, 0.5), (2, "f", 3, 0.0, 0.0, 1, 0.5)], ddl)
    out = D.align_predictions(regression, classification)
    assert out.columns == [*regression.columns, "PredictedMargin_psi"]
    assert sorted(out.collect()) == [(1, "f", 1, 5.0, 4.0, 1, 0.5, 1.0), (1, "f", 2, 3.0, None, None, None, None)]
    assert "Sort" not in _plan(out) and "Window" not in _plan(out)


def test_experiment_metrics_read_the_predictions_once(spark, frame):
    rows = [("a", float(k), float(k + k % 3), "not needed") for k in range(50)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ddl = "e string, ActualStrength28_psi double, PredictedStrength28_psi double, other string"
    predictions = frame(rows, ddl).mapInArrow(count, ddl)
    (got,) = D.experiment_results(predictions, ["e"]).collect()
    assert (got.RowCount, got.TargetP50, got.MAE) == (50, 24.5, 0.98)
    assert seen.value == 50
