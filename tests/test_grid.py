"""Nested folds, the context cube and joint fits against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.operators import encode as N
from pourstat.operators import grid as G
from pourstat.operators import metrics as M
from pourstat.operators import order_stats as O
from pourstat.operators import splits as P

PLAIN = ["EffectiveSlump_in", "AmbientTemp_F", "WaterAdded_gal_per_yd3"]
SETS = {
    "Plain": PLAIN,
    "Context": PLAIN + [f"{c}_{p}" for c in N.CONTEXT for p in G.PARTS],
    "Two": PLAIN[:2],
}


def table(n=500, seed=4, hot=0.35):
    """Rows with a hot group, missing values, ties and a category that one fold has alone."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rnd.random() < hot else f"g{rnd.randrange(25)}"
        supplier, mix = rnd.choice("ABC"), rnd.choice("XY")
        a = None if rnd.random() < 0.2 else round(rnd.uniform(0, 10), 1)
        b = round(rnd.gauss(70, 10))
        c = None if i % 3 else float(i % 7)
        y = 4000 + 150 * (a or 5) - 10 * b + {"A": 0, "B": 300, "C": -200}[supplier] + rnd.gauss(0, 200)
        out.append((i, group, supplier, f"0{rnd.randrange(3)}", mix + ("!" if group == "g3" else ""), a, float(b), c, y, 4000.0))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    ddl = "testId int, SplitGroup string, s string, p string, m string, " + ", ".join(f"{c} double" for c in PLAIN)
    df = spark.createDataFrame(table(), f"{ddl}, {S.TARGET} double, {S.REQUIRED} double")
    df = df.withColumn(S.FAILURE, F.expr(f"CAST({S.TARGET} < {S.REQUIRED} AS INT)"))
    return N.with_context(P.with_nested_folds(df, "SplitGroup"), "s", "p", "m").cache()


def test_nested_folds_belong_to_the_training_side(rows):
    data = rows.select("SplitGroup", "Fold", "InnerFolds").distinct().collect()
    assert len(data) == len({r.SplitGroup for r in data})
    for o in range(1, 6):
        inner = {r.SplitGroup: r.InnerFolds[o - 1] for r in data}
        assert all((inner[r.SplitGroup] is None) == (r.Fold == o) for r in data)
        assert {v for v in inner.values() if v} == {1, 2, 3, 4, 5}
    # The inner folds are not the other outer folds: each is dealt out anew.
    assert any(r.InnerFolds[o - 1] != r.Fold for r in data for o in range(1, 6) if r.Fold != o)


def test_inner_folds_equal_folds_of_the_training_side_alone(rows, spark):
    for o in (1, 4):
        side = rows.where(F.col("Fold") != o)
        alone = {r.SplitGroup: r.Fold for r in P.group_folds(side.drop("Fold"), "SplitGroup").collect()}
        assert alone == {r.SplitGroup: r.i for r in side.select("SplitGroup", F.col("InnerFolds")[o - 1].alias("i")).distinct().collect()}


def test_cube_encoding_equals_means_over_rows(rows):
    data = rows.collect()
    cube = N.context_cube(rows, N.CONTEXT, S.TARGET).cache()
    priors = N.fold_priors(cube, N.CONTEXT[0])
    celled = N.with_context_cells(rows, N.CONTEXT, cube)
    for o in (1, 3, 5):
        train = [r for r in data if r.Fold != o]
        prior = np.mean([r[S.TARGET] for r in train])
        assert priors[o] == pytest.approx(prior)
        for got in celled.withColumns(N.fold_encodings(N.CONTEXT, o, priors[o])).collect():
            for c in N.CONTEXT:
                same = [r for r in train if r[c] == got[c]]
                used = [r[S.TARGET] for r in same if got.Fold == o or r.InnerFolds[o - 1] != got.InnerFolds[o - 1]]
                assert got[f"{c}_TargetMean"] == pytest.approx((sum(used) + 20 * prior) / (len(used) + 20))
                assert got[f"{c}_LogCount"] == pytest.approx(math.log1p(len(same)))
                assert got[f"{c}_Unknown"] == int(not same)


def test_own_target_never_enters_the_own_encoding(rows, spark):
    """Changing the targets of one inner fold leaves its own encodings as they were, but for the prior."""
    o, i = 2, 3
    hit = (F.col("Fold") != o) & (F.col("InnerFolds")[o - 1] == i)
    moved = rows.withColumn(S.TARGET, F.when(hit, F.col(S.TARGET) + 1000).otherwise(F.col(S.TARGET)))
    means = []
    for df in (rows, moved):
        cube = N.context_cube(df, N.CONTEXT, S.TARGET)
        new = N.fold_encodings(N.CONTEXT, o, 0.0)
        out = N.with_context_cells(df, N.CONTEXT, cube).where(hit).withColumns(new)
        means.append({r.testId: [r[f"{c}_TargetMean"] for c in N.CONTEXT] for r in out.collect()})
    assert means[0].keys() == means[1].keys() and len(means[0]) > 20
    for k, v in means[0].items():
        assert means[1][k] == pytest.approx(v)


def test_leave_out_quantiles(frame):
    rnd = random.Random(8)
    data = [(k, f, v) for k in "ab" for f in (1, 2, 3) for v in [rnd.choice([1e9, 1e9 + 1, -3.0, 0.0, 0.5, None, float("nan"), 7.0]) for _ in range(40)]]
    data += [("one", 1, 4.0), ("one", 1, 5.0), ("none", 2, None)]
    out = {(r.k, r.f): r for r in O.leave_out_quantiles(frame(data, "k string, f int, v double"), ["k"], "f", "v", {"m": 0.5, "p9": 0.9}).collect()}
    expected = {}
    for k in ("a", "b", "one"):
        for f in (1, 2, 3):
            rest = [v for a, b, v in data if a == k and b != f and v is not None and not math.isnan(v)]
            if rest:
                expected[k, f] = (np.quantile(rest, 0.5), np.quantile(rest, 0.9))
    assert set(out) == set(expected)
    for key, (m, p9) in expected.items():
        assert (out[key].m, out[key].p9) == (pytest.approx(m), pytest.approx(p9))


def by_hand(data, features, o):
    """Imputed, indicated and standardised matrices of one fold, computed from the rows."""
    train, test = [r for r in data if r["Fold"] != o], [r for r in data if r["Fold"] == o]

    def matrix(rows):
        return np.array([[np.nan if r[c] is None else r[c] for c in features] for r in rows], float)

    a, b = matrix(train), matrix(test)
    missing = np.isnan(a).any(0)
    median = np.nanmedian(a, 0)
    a, b = (np.hstack([np.where(np.isnan(x), median, x), np.isnan(x)[:, missing]]) for x in (a, b))
    varies = a.std(0) > 1e-9
    mean, sd = a[:, varies].mean(0), a[:, varies].std(0)
    return train, test, (a[:, varies] - mean) / sd, (b[:, varies] - mean) / sd


@pytest.fixture(scope="module")
def packed(rows):
    return G.pack(rows, SETS)


@pytest.fixture(scope="module")
def encoded(rows):
    cube = N.context_cube(rows, N.CONTEXT, S.TARGET)
    priors = N.fold_priors(cube, N.CONTEXT[0])
    celled = N.with_context_cells(rows, N.CONTEXT, cube).cache()
    return {o: [r.asDict() for r in celled.withColumns(N.fold_encodings(N.CONTEXT, o, priors[o])).collect()] for o in priors}


def test_ridge_and_least_squares_of_the_grid(packed, encoded):
    models = G.fit_regressions(packed, SETS, {"LinearRegression": 0.0, "Ridge": 10.0})
    got = {(r.FeatureSet, r.Model, r.testId): r[M.PREDICTED] for r in G.predict(packed, models).collect()}
    assert len(got) == 500 * 3 * 4
    for o, data in encoded.items():
        for name, features in SETS.items():
            train, test, a, b = by_hand(data, features, o)
            y = np.array([r[S.TARGET] for r in train])
            ridge = np.linalg.solve(a.T @ a + 10 * np.eye(a.shape[1]), a.T @ (y - y.mean()))
            least = np.linalg.lstsq(a, y - y.mean(), rcond=1e-6)[0]
            for k, r in enumerate(test):
                assert got[name, "Ridge", r["testId"]] == pytest.approx(y.mean() + b[k] @ ridge, rel=1e-6)
                assert got[name, "LinearRegression", r["testId"]] == pytest.approx(y.mean() + b[k] @ least, rel=1e-5)
                assert got[name, "DummyMean", r["testId"]] == pytest.approx(y.mean())
                assert got[name, "DummyMedian", r["testId"]] == pytest.approx(np.median(y))


def test_collinear_columns_have_a_least_squares_fit(rows):
    twice = rows.withColumn("Copy", F.col(PLAIN[1]) * 2 + 1)
    sets = {"Once": PLAIN[:2], "Twice": [*PLAIN[:2], "Copy"]}
    f = G.pack(twice, sets)
    wide = G.predict(f, G.fit_regressions(f, sets, {"LinearRegression": 0.0})).where("Model = 'LinearRegression'")
    both = wide.groupBy("testId").pivot("FeatureSet", ["Once", "Twice"]).agg(F.first(M.PREDICTED)).collect()
    assert all(r.Once == pytest.approx(r.Twice, rel=1e-6) for r in both)


def test_logistic_equals_spark_ml(rows, spark):
    f = G.pack(rows, SETS, label=S.FAILURE)
    models = G.fit_logistic(f, SETS)
    got = {(r.FeatureSet, r.Model, r.testId): r[M.SCORE] for r in G.predict(f, models, classify=True).collect()}
    assert len(got) == 500 * 3 * 2
    cube = N.context_cube(rows, N.CONTEXT, S.FAILURE)
    priors = N.fold_priors(cube, N.CONTEXT[0])
    o = 2
    celled = N.with_context_cells(rows, N.CONTEXT, cube).withColumns(N.fold_encodings(N.CONTEXT, o, priors[o]))
    train, test, a, b = by_hand([r.asDict() for r in celled.collect()], SETS["Context"], o)
    y = [r[S.FAILURE] for r in train]
    n, ones = len(y), sum(y)
    weight = [n / (2 * ones) if v else n / (2 * (n - ones)) for v in y]
    df = spark.createDataFrame([(Vectors.dense(x), float(v), w) for x, v, w in zip(a, y, weight)], ["features", "label", "w"])
    model = LogisticRegression(weightCol="w", regParam=1.0 / n, maxIter=500, tol=1e-13, standardization=False).fit(df)
    for k, r in enumerate(test):
        p = 1 / (1 + math.exp(-(b[k] @ model.coefficients.toArray() + model.intercept)))
        assert got["Context", "LogisticRegression", r["testId"]] == pytest.approx(p, abs=1e-6)
        assert got["Context", "DummyPrior", r["testId"]] == pytest.approx(ones / n)


def test_many_partial_sums_are_added_in_two_steps(packed, monkeypatch):
    once = G.training_moments(packed)
    monkeypatch.setattr(G, "DIRECT_PARTIALS", 1)
    twice = G.training_moments(packed)
    for o in once:
        assert np.allclose(once[o].total, twice[o].total, rtol=1e-9, atol=1e-6)


def test_one_class_has_only_the_prior(rows):
    same = rows.withColumn(S.FAILURE, F.lit(0))
    f = G.pack(same, {"Two": PLAIN[:2]}, label=S.FAILURE)
    models = G.fit_logistic(f, {"Two": PLAIN[:2]})
    assert {m.model for m in models} == {"DummyPrior"}
    assert {r[M.SCORE] for r in G.predict(f, models, classify=True).collect()} == {0.0}


def test_leaks_are_refused(rows):
    with pytest.raises(ValueError, match="leakage"):
        G.pack(rows, {"Bad": [S.FAILURE]})


def test_fold_summary(rows):
    data = rows.collect()
    for r in G.fold_summary(rows, "Fold", S.TARGET, "SplitGroup").collect():
        train = [x for x in data if x.Fold != r.Fold]
        held = [x for x in data if x.Fold == r.Fold]
        for side, part in (("Train", train), ("Validation", held)):
            y = [x[S.TARGET] for x in part]
            assert r[f"{side}Rows"] == len(part) and r[f"{side}ProjectGroups"] == len({x.SplitGroup for x in part})
            assert r[f"{side}TargetMean"] == pytest.approx(np.mean(y)) and r[f"{side}TargetStd"] == pytest.approx(np.std(y, ddof=1))
        assert r.TrainTargetMedian == pytest.approx(np.median([x[S.TARGET] for x in train]))


def test_encodings_are_worked_out_once_per_combination(rows, monkeypatch):
    seen = []
    cells = N.with_context_cells
    monkeypatch.setattr(N, "with_context_cells", lambda df, *rest: seen.append(df) or cells(df, *rest))
    alike = rows.withColumns({c: F.lit("A") for c in N.CONTEXT})
    f = G.pack(alike, {"Context": SETS["Context"]})
    assert [df.count() for df in seen] == [rows.select("Fold", "InnerFolds").distinct().count()]
    assert f.rows.count() < 500 and f.rows.agg(F.sum(F.size("_id"))).first()[0] == 500  # passes read blocks, not rows


def test_values_counted_in_tasks_give_the_medians(rows, monkeypatch):
    monkeypatch.setattr(G, "HELD_VALUES", 16)
    monkeypatch.setattr(G, "BLOCK_ROWS", 7)
    f = G.pack(rows, {"Plain": PLAIN})
    data = rows.collect()
    for o in range(1, 6):
        for k, c in enumerate(PLAIN):
            assert f.medians[o - 1, k] == pytest.approx(np.median([r[c] for r in data if r.Fold != o and r[c] is not None]))
    counts = G._value_counts(f).groupBy("Column").agg(F.sum("_rows").alias("n")).collect()
    assert {r.Column: r.n for r in counts} == {0: 500} | {k + 1: sum(r[c] is not None for r in data) for k, c in enumerate(PLAIN)}


def test_one_frame_has_the_encodings_of_both_labels(rows):
    sets = {"Context": SETS["Context"]}
    both = G.pack(rows, sets, label=(S.TARGET, S.FAILURE))
    for label in (S.TARGET, S.FAILURE):
        alone, shared = (G.training_moments(f) for f in (G.pack(rows, sets, label=label), both.encoded_by(label)))
        for o in alone:
            assert np.allclose(alone[o].total, shared[o].total, rtol=1e-9, atol=1e-6)


def test_logistic_starts_from_the_discriminant(rows, monkeypatch):
    sets = {"Context": SETS["Context"]}
    f = G.pack(rows, sets, label=S.FAILURE)
    moments, add_up, passes = G.training_moments(f), G.add_up, []
    monkeypatch.setattr(G, "add_up", lambda *a: passes.append(1) or add_up(*a))
    weights = {}
    start = G._discriminant
    for name, begin in (("far", lambda *a: start(*a) + 40.0), ("zero", lambda *a: start(*a) * 0.0), ("near", start)):
        monkeypatch.setattr(G, "_discriminant", begin)
        passes.clear()
        weights[name] = [m for m in G.fit_logistic(f, sets, moments=moments) if m.model == "LogisticRegression"]
        weights[f"{name} passes"] = len(passes)
    for a, b, c in zip(weights["near"], weights["zero"], weights["far"]):
        for other in (b, c):
            assert np.allclose(a.weights, other.weights, rtol=1e-6, atol=1e-7) and a.constant == pytest.approx(other.constant, rel=1e-6, abs=1e-6)
    assert weights["near passes"] < weights["zero passes"] < weights["far passes"]
