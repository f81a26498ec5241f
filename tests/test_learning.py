"""Splits, encoding, metrics, sweeps and models."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.operators import decide as D
from pourstat.operators import encode as N
from pourstat.operators import metrics as M
from pourstat.operators import mixes as X
from pourstat.operators import models as L
from pourstat.operators import splits as P


def grouped_rows(n=400, seed=5):
    rnd = random.Random(seed)
    return [(i, "hot" if rnd.random() < 0.33 else f"g{rnd.randrange(30)}", rnd.choice("abcd"), rnd.uniform(0, 10)) for i in range(n)]


def test_folds_are_disjoint_and_cover(frame):
    df = frame(grouped_rows(), "i int, g string, c string, y double")
    out = P.with_folds(df, "g").collect()
    assert len(out) == 400 and {r["Fold"] for r in out} == {1, 2, 3, 4, 5}
    per_group = {}
    for r in out:
        per_group.setdefault(r["g"], set()).add(r["Fold"])
    assert all(len(f) == 1 for f in per_group.values())


def test_folds_need_two_groups(frame):
    with pytest.raises(Exception, match="at least two groups"):
        P.with_folds(frame([(1, "g")], "i int, g string"), "g").collect()


def test_split_is_group_disjoint(frame):
    df = P.train_validation_test(frame(grouped_rows(), "i int, g string, c string, y double"), "g")
    P.assert_disjoint(df.where("DatasetSplit = 'train'"), df.where("DatasetSplit <> 'train'"), "g")
    with pytest.raises(ValueError, match="both sides"):
        P.assert_disjoint(df, df, "g")


def test_encoding_matches_direct_out_of_fold_means(frame):
    rows = [(i, c, y, i % 4, "test" if i % 5 == 0 else "train") for i, _, c, y in grouped_rows(120)]
    rows.append((999, "never seen", 1.0, 1, "test"))
    df = frame(rows, "i int, c string, y double, f int, Role string")
    out = {r["i"]: r for r in N.cross_fitted_encode(df, ["c"], "y", "f").collect()}
    train = [r for r in rows if r[4] == "train"]
    prior = np.mean([r[2] for r in train])
    for i, c, y, f, role in rows:
        used = [r[2] for r in train if r[1] == c and (role == "test" or r[3] != f)]
        assert out[i]["c_TargetMean"] == pytest.approx((sum(used) + 20 * prior) / (len(used) + 20))
        assert out[i]["c_LogCount"] == pytest.approx(math.log1p(len([r for r in train if r[1] == c])))
    assert out[999]["c_TargetMean"] == pytest.approx(prior) and out[999]["c_Unknown"] == 1


def test_own_fold_never_enters_the_encoding(frame):
    rows = [(i, c, y, i % 4, "train") for i, _, c, y in grouped_rows(80)]
    moved = [(i, c, y + (1000.0 if f == 2 else 0.0), f, r) for i, c, y, f, r in rows]
    ddl = "i int, c string, y double, f int, Role string"
    centred = []
    for data in (rows, moved):
        prior = np.mean([r[2] for r in data])
        out = N.cross_fitted_encode(frame(data, ddl), ["c"], "y", "f").where("f = 2").collect()
        counts = {c: sum(1 for r in data if r[1] == c and r[3] != 2) for c in "abcd"}
        centred.append({r["i"]: r["c_TargetMean"] - 20 * prior / (counts[r["c"]] + 20) for r in out})
    assert centred[0] == pytest.approx(centred[1])


def test_imputation_and_scaling_use_train_only(frame):
    df = frame([(1, "train", 1.0), (2, "train", 3.0), (3, "train", None), (4, "test", None), (5, "test", 99.0)], "i int, Role string, x double")
    out = {r["i"]: r for r in N.impute_medians(df, ["x"]).collect()}
    assert out[4]["x"] == 2.0 and out[4]["x_WasMissing"] == 1 and out[5]["x_WasMissing"] == 0
    scaled = {r["i"]: r["x_Scaled"] for r in N.standardize(df, ["x"]).collect()}
    assert scaled[1] == -1.0 and scaled[5] == 97.0


def test_class_weights(frame):
    df = frame([(0,), (0,), (0,), (1,)], "y int")
    assert {r["y"]: r["ClassWeight"] for r in N.class_weights(df, "y").collect()} == {0: pytest.approx(4 / 6), 1: 2.0}


def predictions(seed, n=300):
    rnd = random.Random(seed)
    return [("s", rnd.uniform(1000, 9000), rnd.uniform(1000, 9000), rnd.randrange(2), rnd.choice([0.1, 0.2, 0.35, 0.5, 0.9])) for _ in range(n)]


PRED = f"k string, {M.ACTUAL} double, {M.PREDICTED} double, {M.FAILED} int, {M.SCORE} double"


def test_regression_metrics_match_numpy(frame):
    rows = predictions(1)
    r = M.regression_metrics(frame(rows, PRED), ["k"]).first()
    y, p = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    e = p - y
    assert r["MAE"] == pytest.approx(np.abs(e).mean()) and r["MedianAE"] == pytest.approx(np.median(np.abs(e)))
    assert r["RMSE"] == pytest.approx(np.sqrt((e**2).mean())) and r["P90AbsoluteError"] == pytest.approx(np.quantile(np.abs(e), 0.9))
    assert r["R2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()) and r["MeanBias"] == pytest.approx(e.mean())


def test_constant_target_r2(frame):
    same = M.regression_metrics(frame([("s", 5.0, 5.0, 0, 0.1)] * 2, PRED), ["k"]).first()
    off = M.regression_metrics(frame([("s", 5.0, 6.0, 0, 0.1)] * 2, PRED), ["k"]).first()
    assert (same["R2"], off["R2"]) == (1.0, 0.0)


def test_ranking_metrics_match_pairs(frame):
    rows = predictions(2, 120)
    r = M.ranking_metrics(frame(rows, PRED), ["k"]).first()
    pos, neg = [x[4] for x in rows if x[3]], [x[4] for x in rows if not x[3]]
    auc = np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg])
    ap, last = 0.0, 0
    for cut in sorted({x[4] for x in rows}, reverse=True):
        tp, n = sum(x[3] for x in rows if x[4] >= cut), sum(x[4] >= cut for x in rows)
        ap, last = ap + (tp - last) / len(pos) * tp / n, tp
    assert r["ROC_AUC"] == pytest.approx(auc) and r["AveragePrecision_PR_AUC"] == pytest.approx(ap)


def test_one_class_has_no_auc(frame):
    r = M.classification_metrics(frame([("s", 1.0, 1.0, 0, 0.2), ("s", 1.0, 1.0, 0, 0.4)], PRED), ["k"]).first()
    assert r["ROC_AUC"] is None and r["Precision"] == 0.0 and r["Recall"] == 0.0 and r["AveragePrecision_PR_AUC"] == 0.0


@pytest.mark.parametrize("at_most", [True, False])
def test_sweep_matches_brute_force(frame, at_most):
    rows = predictions(3)
    grid = [0.05, 0.1, 0.2, 0.35, 0.4, 0.95]
    out = {r["Threshold"]: r for r in D.sweep(frame(rows, PRED), ["k"], M.SCORE, grid, "m", "u", at_most).collect()}
    assert sorted(out) == grid
    for t in grid:
        hit = [(x[4] <= t) if at_most else (x[4] >= t) for x in rows]
        tp = sum(h and x[3] for h, x in zip(hit, rows))
        assert out[t]["TruePositives"] == tp and out[t]["FalsePositives"] == sum(hit) - tp
        assert out[t]["TruePositives"] + out[t]["FalsePositives"] + out[t]["FalseNegatives"] + out[t]["TrueNegatives"] == len(rows)
    recalls = [out[t]["Recall"] for t in grid]
    assert recalls == sorted(recalls, reverse=not at_most)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=40))
def test_chosen_threshold_is_best(spark, pairs):
    if not any(y for y, _ in pairs):
        return
    rows = [("s", 1.0, 1.0, y, p / 20) for y, p in pairs]
    r = D.choose_threshold(spark.createDataFrame(rows, PRED), ["k"], 0.8).first()
    total = sum(y for y, _ in pairs)
    best = None
    for t in {p / 20 for _, p in pairs}:
        tp, n = sum(y for y, p in pairs if p / 20 >= t), sum(p / 20 >= t for _, p in pairs)
        if tp / total >= 0.8:
            best = max(best or (0, 0), (tp / n, t))
    assert (r["Precision"], r["Threshold"]) == pytest.approx(best)


def test_unreachable_recall_targets_stay(frame):
    rows = [("A", "s", 1, 0.5, 100.0), ("A", "s", 0, 0.5, 2000.0)]
    df = frame(rows, f"FeatureSet string, k string, {M.FAILED} int, {M.SCORE} double, PredictedMargin_psi double")
    out = D.matched_recall(D.full_sweep(df)).collect()
    assert len(out) == len(S.RECALL_TARGETS) and all(r["RegressionRecall"] == 1.0 for r in out)


def test_review_rules_with_missing_values(frame):
    ddl = "FailureRate_percent double, P10SpecMargin_psi double, AverageSpecMargin_psi double, StrengthCV_percent double, CementitiousVsProjectMedian_percent double"
    rows = [
        (6.0, 100.0, 2000.0, 5.0, 0.0),
        (0.0, -1.0, 2000.0, 5.0, 0.0),
        (0.0, 100.0, 1300.0, 5.0, 4.0),
        (0.0, 100.0, 1300.0, 5.0, None),
        (0.0, 100.0, 800.0, 5.0, None),
        (0.0, 100.0, 800.0, 5.0, 3.0),
        (None, None, None, None, None),
        (0.0, 100.0, 1300.0, None, 0.0),
    ]
    out = X.with_review_flag(frame(rows, ddl)).collect()
    assert [r["ReviewPriority"] for r in out] == [1, 1, 2, 2, 3, 4, 4, 4]
    assert out[2]["RecommendedAction"].endswith("peer median.") and out[3]["RecommendedAction"].endswith("benchmark mixes.")


def test_checked_merges(frame):
    a, b = frame([(1, "x"), (1, "y")], "k int, v string"), frame([(1, 5.0)], "k int, w double")
    with pytest.raises(ValueError, match="not unique"):
        D.merge_one_to_one(a, b, ["k"])
    assert D.merge_many_to_one(a, b, ["k"], "w").count() == 2
    with pytest.raises(Exception, match="no w for a row"):
        D.merge_many_to_one(frame([(2, "z")], "k int, v string"), b, ["k"], "w").collect()


def planted(frame, n=400):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        x, z = rnd.uniform(0, 10), rnd.uniform(0, 1)
        y = 3000 + 200 * x + 500 * z + rnd.gauss(0, 30)
        rows.append((i, "test" if i % 4 == 0 else "train", None if i % 17 == 0 else x, z, y, int(y < 4200)))
    return frame(rows, "testId int, Role string, x double, z double, y double, bad int")


def test_ridge_equals_normal_equations(frame):
    df = planted(frame).dropna()
    out = L.evaluate_split(df, {"f": ["x", "z"]}, {"Ridge": L.regressors()["Ridge"]}, "y", ["testId"])
    got = {r["testId"]: r[M.PREDICTED] for r in out.collect()}
    rows = df.collect()
    train = np.array([[r["x"], r["z"]] for r in rows if r["Role"] == "train"])
    y = np.array([r["y"] for r in rows if r["Role"] == "train"])
    mean, sd = train.mean(0), train.std(0, ddof=1)
    a = (train - mean) / sd
    w = np.linalg.solve(a.T @ a + 10.0 * np.eye(2), a.T @ (y - y.mean()))
    for r in rows:
        if r["Role"] == "test":
            want = y.mean() + (np.array([r["x"], r["z"]]) - mean) / sd @ w
            assert got[r["testId"]] == pytest.approx(want, rel=1e-6)


def test_models_beat_the_baseline(frame):
    size = L.Size(trees=10, rounds=10, depth=5)
    out = L.evaluate_split(planted(frame), {"f": ["x", "z"]}, L.regressors(size), "y", ["testId"])
    mae = {r["Model"]: r["MAE"] for r in M.regression_metrics(out, ["Model"]).collect()}
    assert set(mae) == {"DummyMean", "LinearRegression", "Ridge", "RandomForest", "GradientBoosting"}
    assert all(v < 0.8 * mae["DummyMean"] for k, v in mae.items() if k != "DummyMean")


def test_classifiers_beat_the_prior(frame):
    size = L.Size(trees=10, rounds=5, depth=5)
    out = L.evaluate_split(planted(frame), {"f": ["x", "z"]}, L.classifiers(size), "bad", ["testId"], classify=True)
    auc = {r["Model"]: r["ROC_AUC"] for r in M.ranking_metrics(out, ["Model"]).collect()}
    assert auc.pop("DummyPrior") == 0.5 and all(v > 0.9 for v in auc.values())


def test_leakage_columns_are_refused(frame):
    with pytest.raises(ValueError, match="leakage"):
        L.evaluate_split(planted(frame), {"f": ["x", S.FAILURE]}, {}, "y", ["testId"])
