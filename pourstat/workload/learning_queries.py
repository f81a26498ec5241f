"""Queries that train models.

SQL checks folds, encodings, imputation values, baselines and least squares on one feature;
the other models have no SQL, so only rows are checked and the tests compare their values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import boost as B
from pourstat.operators import clean as C
from pourstat.operators import encode as N
from pourstat.operators import grid as G
from pourstat.operators import metrics as M
from pourstat.operators import models as L
from pourstat.operators import scenarios as V
from pourstat.operators import splits as P
from pourstat.operators import surrogates as U
from pourstat.operators.order_stats import leave_out_quantiles, unpivot
from pourstat.session import durable, stored
from pourstat.workload.model_queries import CONTEXT, GROUP_SQL, bucket
from pourstat.workload.registry import R, Tables, query, rounded
from pourstat.workload.standins import cte

# Fewer rounds and trees than the library's defaults, for the queries that name them; README has measured times.
SMALL = L.Size(trees=8, rounds=4, depth=6)
ROUNDS = B.BoostParams(rounds=12)
TREES = B.ForestParams(trees=40, depth=10)
SCENARIO_SEED = 7


def rows(t: Tables, folds: int = 5):
    facts = t["facts"].withColumn("SplitGroup", E.project_group("projectId", "testId"))
    return L.experiment_rows(facts, "SplitGroup", folds)


# ---------------------------------------------------------------- nested folds in SQL
_ROWS = cte("facts") + f""", src AS (SELECT *, {GROUP_SQL} AS SplitGroup, {S.TARGET} AS y, {S.DAY7} AS d7 FROM facts
  WHERE {S.TARGET} > 0 AND {S.REQUIRED} > 0 AND {S.DAY7} > 0)
, z AS (SELECT SplitGroup, count(*) AS n FROM src GROUP BY 1), pl AS (SELECT SplitGroup, n, row_number() OVER (ORDER BY n DESC, md5(SplitGroup), SplitGroup) - 1 AS a, least(5, (SELECT count(*) FROM z)) AS k FROM z)
, f1 AS (SELECT SplitGroup, n, CAST(CASE WHEN (a // k) % 2 = 0 THEN a % k + 1 ELSE k - a % k END AS INT) AS Fold FROM pl)
, sd AS (SELECT f1.*, CAST(o AS INT) AS OuterFold, row_number() OVER (PARTITION BY o ORDER BY n DESC, md5(SplitGroup), SplitGroup) - 1 AS a, least(5, count(*) OVER (PARTITION BY o)) AS k FROM f1, range(1, 6) r(o) WHERE Fold <> o)
, f2 AS (SELECT SplitGroup, OuterFold, CAST(CASE WHEN (a // k) % 2 = 0 THEN a % k + 1 ELSE k - a % k END AS INT) AS InnerFold FROM sd)
, g AS (SELECT src.*, f1.Fold FROM src JOIN f1 USING (SplitGroup))""" + CONTEXT + """
, nf AS (SELECT ctx.*, CAST(r.o AS INT) AS OuterFold, f2.InnerFold FROM ctx CROSS JOIN range(1, 6) r(o) LEFT JOIN f2 ON f2.SplitGroup = ctx.SplitGroup AND f2.OuterFold = r.o)"""
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS ContextColumn, {c} AS Category, testId, OuterFold, InnerFold, Fold, y FROM nf" for c in N.CONTEXT)


@query("mod09_nested_folds", _ROWS + " SELECT testId, Fold, OuterFold, InnerFold FROM nf")
def _(t):
    nested = rows(t).select("testId", "Fold", F.posexplode("InnerFolds").alias("_at", "InnerFold"))
    return nested.select("testId", "Fold", (F.col("_at") + 1).cast("int").alias("OuterFold"), "InnerFold")


@query("mod09_context_cube", _ROWS + f""", u AS ({_LONG})
SELECT ContextColumn, Category, OuterFold, coalesce(InnerFold, 0) AS InnerFold, {R('sum(y)', 'Sum')}, count(y) AS "Count" FROM u GROUP BY 1, 2, 3, 4
UNION ALL SELECT ContextColumn, Category, 0, 0, {R('sum(y)', 'Sum')}, count(y) FROM u WHERE OuterFold = 1 GROUP BY 1, 2""")
def _(t):
    return rounded(N.context_cube(rows(t), N.CONTEXT, S.TARGET))


# The SQL takes every mean over the rows it is made from: other inner folds for a training row,
# the whole training side for a validation row.
@query("enc02_mod09_nested_encoding", _ROWS + f""", u AS ({_LONG}), pr AS (SELECT OuterFold, avg(y) AS m FROM nf WHERE InnerFold IS NOT NULL GROUP BY 1)
, cell AS (SELECT ContextColumn, Category, OuterFold, InnerFold, sum(y) AS s, count(*) AS n FROM u WHERE InnerFold IS NOT NULL GROUP BY 1, 2, 3, 4)
, side AS (SELECT ContextColumn, Category, OuterFold, sum(s) AS s, sum(n) AS n FROM cell GROUP BY 1, 2, 3)
, rest AS (SELECT w.ContextColumn, w.Category, w.OuterFold, w.InnerFold, sum(c.s) AS s, sum(c.n) AS n FROM (SELECT DISTINCT ContextColumn, Category, OuterFold, InnerFold FROM u WHERE InnerFold IS NOT NULL) w
  JOIN cell c ON c.ContextColumn = w.ContextColumn AND c.Category = w.Category AND c.OuterFold = w.OuterFold AND c.InnerFold <> w.InnerFold GROUP BY 1, 2, 3, 4)
SELECT u.testId, u.OuterFold, u.ContextColumn, {R('CASE WHEN u.InnerFold IS NULL THEN (coalesce(side.s, 0) + 20 * m) / (coalesce(side.n, 0) + 20) ELSE (coalesce(rest.s, 0) + 20 * m) / (coalesce(rest.n, 0) + 20) END', 'TargetMean')},
 {R('ln(1 + coalesce(side.n, 0))', 'LogCount')}, CASE WHEN side.n IS NULL THEN 1 ELSE 0 END AS Unknown
FROM u JOIN pr USING (OuterFold) LEFT JOIN side USING (ContextColumn, Category, OuterFold) LEFT JOIN rest USING (ContextColumn, Category, OuterFold, InnerFold)""")
def _(t):
    df = rows(t).select("testId", "Fold", "InnerFolds", S.TARGET, *N.CONTEXT)
    cube = durable(N.context_cube(df, N.CONTEXT, S.TARGET))
    priors = N.fold_priors(cube, N.CONTEXT[0])
    celled = N.with_context_cells(df, N.CONTEXT, cube)
    per_fold = celled.select("testId", F.posexplode(N.grid_encodings(N.CONTEXT, priors)).alias("_at", "_values"))
    items = [
        F.struct(
            F.lit(c).alias("ContextColumn"), F.col("_values")[3 * k].alias("TargetMean"), F.col("_values")[3 * k + 1].alias("LogCount"),
            F.col("_values")[3 * k + 2].cast("int").alias("Unknown"),
        )
        for k, c in enumerate(N.CONTEXT)
    ]
    outer = (F.col("_at") + 1).cast("int").alias("OuterFold")
    return rounded(per_fold.select("testId", outer, F.explode(F.array(*items)).alias("e")).select("testId", "OuterFold", "e.*"))


# ---------------------------------------------------------------- joint fits
_PLAIN = [*S.DAY0_FEATURES, S.DAY7]


@query("mod01_training_medians", _ROWS + ", md AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"Column\", OuterFold AS Fold, {R(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'TrainMedian')} FROM nf WHERE InnerFold IS NOT NULL GROUP BY 2" for c in _PLAIN
) + ") SELECT * FROM md WHERE TrainMedian IS NOT NULL")
def _(t):
    long = unpivot(rows(t), ["Fold"], _PLAIN)
    return rounded(leave_out_quantiles(long, ["Column"], "Fold", "Value", {"TrainMedian": 0.5}))


def _side(role: str, condition: str) -> str:
    return f"""count(*) FILTER ({condition}) AS {role}Rows, count(DISTINCT SplitGroup) FILTER ({condition}) AS {role}ProjectGroups,
 {R(f'avg(y) FILTER ({condition})', f'{role}TargetMean')}, {R(f'stddev_samp(y) FILTER ({condition})', f'{role}TargetStd')}"""


@query("grp31_cv_fold_summary", _ROWS + f""" SELECT OuterFold AS Fold, {_side('Train', 'Fold <> OuterFold')}, {_side('Validation', 'Fold = OuterFold')},
 {R('quantile_cont(y, 0.5) FILTER (Fold <> OuterFold)', 'TrainTargetMedian')} FROM nf GROUP BY 1""")
def _(t):
    return rounded(G.fold_summary(rows(t), "Fold", S.TARGET, "SplitGroup"))


_ONE = {"OneFeature": ["Day7AverageStrength_psi"]}
_SCORED = """, st AS (SELECT OuterFold, avg(y) AS my, quantile_cont(y, 0.5) AS q, avg(d7) AS mx, regr_slope(y, d7) AS slope, regr_intercept(y, d7) AS icept, var_pop(d7) AS v, count(*) AS n
 FROM nf WHERE InnerFold IS NOT NULL GROUP BY 1)
, pr AS (SELECT g.testId, g.Fold, m.Model, g.y AS actual, CASE m.Model WHEN 'DummyMean' THEN my WHEN 'DummyMedian' THEN q WHEN 'LinearRegression' THEN icept + slope * d7
  ELSE my + slope * n / (n + 10) * (d7 - mx) END AS predicted FROM g JOIN st ON st.OuterFold = g.Fold, (VALUES ('DummyMean'), ('DummyMedian'), ('LinearRegression'), ('Ridge')) m(Model))"""


@query("mod04_one_feature_predictions", _ROWS + _SCORED + f" SELECT testId, Fold, Model, {R('predicted', 'PredictedStrength28_psi', 4)} FROM pr")
def _(t):
    out = G.cross_validate_linear(rows(t), _ONE)
    return rounded(out.select("testId", "Fold", "Model", M.PREDICTED), 4)


@query("mod04_one_feature_fold_metrics", _ROWS + _SCORED + f""", e AS (SELECT *, predicted - actual AS r FROM pr)
SELECT Fold, Model, count(*) AS RowCount, {R('avg(abs(r))', 'MAE', 4)}, {R('sqrt(avg(r * r))', 'RMSE', 4)}, {R('1 - sum(r * r) / (var_pop(actual) * count(*))', 'R2', 4)}, {R('avg(r)', 'MeanBias', 4)} FROM e GROUP BY 1, 2""")
def _(t):
    out = M.regression_metrics(G.cross_validate_linear(rows(t), _ONE), ["Fold", "Model"], quantiles=False)
    return rounded(out.drop("Within300PsiPercent", "Within500PsiPercent"), 4)


_SETS_SQL = ", ".join(f"('{n}')" for n in L.four_feature_sets())


# Which predictions the whole grid makes, with the actual values and the baselines of every fold.
@query("mod04_09_grid_keys", _ROWS + _SCORED + f""" SELECT v.FeatureSet, testId, Fold, Model, actual AS ActualStrength28_psi,
 {R("CASE WHEN Model IN ('DummyMean', 'DummyMedian') THEN predicted END", 'Baseline', 4)} FROM pr, (VALUES {_SETS_SQL}) v(FeatureSet)""")
def _(t):
    out = G.cross_validate_linear(rows(t), L.four_feature_sets())
    baseline = F.when(F.col("Model").startswith("Dummy"), F.col(M.PREDICTED)).alias("Baseline")
    return rounded(out.select("FeatureSet", "testId", "Fold", "Model", M.ACTUAL, baseline), 4)


@query("mod04_09_regression_cross_validation")
def _(t):
    out = G.cross_validate_linear(rows(t), L.four_feature_sets()).select("FeatureSet", "Model", "Fold", M.ACTUAL, M.PREDICTED)
    return M.regression_metrics(stored(out), ["FeatureSet", "Model", "Fold"])  # every step of the metrics reads them


@query("mod05_09_risk_cross_validation")
def _(t):
    return M.classification_metrics(G.cross_validate_logistic(rows(t), L.four_feature_sets()), ["FeatureSet", "Model", "Fold"])


# ---------------------------------------------------------------- trees on the holdout
@query("mod07_10_holdout_boosting")
def _(t):
    """Leaf-wise boosting of all four feature sets on one outer fold."""
    sets = L.four_feature_sets()
    rows_ = durable(L.holdout_rows(P.fold_roles(rows(t), 1), sets, S.TARGET))
    scores, _, _ = B.boost(rows_, sets, S.TARGET)
    return M.regression_metrics(scores.withColumnRenamed("y", M.ACTUAL).withColumnRenamed("Score", M.PREDICTED), ["FeatureSet"])


@query("mod07_10_holdout_risk_boosting")
def _(t):
    """The same for failures, with balanced weights."""
    sets = L.four_feature_sets()
    split = P.fold_roles(rows(t), 1)
    rows_ = durable(N.class_weights(L.holdout_rows(split, sets, S.FAILURE), S.FAILURE))
    scores, _, _ = B.boost(rows_, sets, S.FAILURE, ROUNDS, classify=True, weight="ClassWeight")
    out = scores.select("FeatureSet", F.col("y").cast("int").alias(M.FAILED), F.col("Score").alias(M.SCORE))
    return M.classification_metrics(out, ["FeatureSet"])


@query("mod06_10_holdout_extra_trees")
def _(t):
    """Extremely randomised trees on imputed field, requirement and day-7 values."""
    features = L.four_feature_sets()["Day7_FieldPlusRequired"]
    split = P.fold_roles(rows(t), 1)
    filled = N.impute_medians(split.select("testId", "Role", S.TARGET, *[c for c in features if c != S.TARGET]), features)
    scores, _ = B.extra_trees(durable(filled), features, S.TARGET, TREES)
    named = scores.select(F.lit("Day7_FieldPlusRequired").alias("FeatureSet"), F.col("y").alias(M.ACTUAL), F.col("Score").alias(M.PREDICTED))
    return M.regression_metrics(named, ["FeatureSet"])


@query("mod04_05_10_holdout_linear")
def _(t):
    """Ridge and balanced logistic regression on the same holdout, all four sets, in one long table."""
    sets = L.four_feature_sets()
    split = P.fold_roles(rows(t), 1)
    out = None
    for classify in (False, True):
        f = G.pack_holdout(split, sets, label=S.FAILURE if classify else S.TARGET)
        models = G.fit_logistic(f, sets) if classify else G.fit_regressions(f, sets, {"LinearRegression": 0.0, "Ridge": G.RIDGE_PENALTY})
        table = V.metrics(G.predict(f, models, classify), classify, ["FeatureSet", "Model"])
        part = unpivot(table, ["FeatureSet", "Model"], [c for c in table.columns if c not in ("FeatureSet", "Model")], "Metric", "Value")
        out = part if out is None else out.unionByName(part)
    return out


@query("mod06_07_10_holdout_regression")
def _(t):
    """The Spark ML models on the same holdout."""
    sets = {"Day7_FieldPlusRequired": L.four_feature_sets()["Day7_FieldPlusRequired"]}
    split = P.fold_roles(rows(t), 1)
    return M.regression_metrics(L.holdout(split, sets, L.regressors()), ["FeatureSet", "Model"])


@query("mod06_07_10_holdout_risk")
def _(t):
    sets = {"Day0_FieldPlusRequired": S.DAY0_FEATURES}
    split = P.fold_roles(rows(t), 1)
    return M.classification_metrics(L.holdout(split, sets, L.classifiers(SMALL), classify=True), ["FeatureSet", "Model"])


# ---------------------------------------------------------------- validation from outside
_LAB = cte("facts") + f""", g AS (SELECT *, {GROUP_SQL} AS SplitGroup, {S.TARGET} AS y, {S.DAY7} AS d7, CAST({S.TARGET} < {S.REQUIRED} AS INT) AS bad FROM facts WHERE {S.TARGET} > 0 AND {S.REQUIRED} > 0)""" + CONTEXT
_EXT = """, rl AS (SELECT *, year(castDate) AS yr, CASE WHEN year(castDate) <= 1998 THEN 'train' WHEN year(castDate) BETWEEN 1999 AND 2001 THEN 'test' END AS Role FROM ctx WHERE year(castDate) <= 2001)
, st AS (SELECT 'Day0_Context' AS Stage, * FROM rl UNION ALL SELECT 'Day7_FullUpdated', * FROM rl WHERE d7 > 0)"""
_UNSEEN = f""", sc AS (SELECT 'UnseenSupplier' AS Scenario, SupplierCategory AS ScenarioGroup, * FROM ctx WHERE SupplierCategory <> '__MISSING__' UNION ALL
 SELECT 'UnseenSupplierPlantMix', SupplierPlantMixCategory, * FROM ctx WHERE SupplierCategory <> '__MISSING__' AND PlantCategory <> '__MISSING__' AND MixCategory <> '__MISSING__')
, rl AS (SELECT *, CASE WHEN {bucket(SCENARIO_SEED, 'ScenarioGroup')} < 20 THEN 'test' ELSE 'train' END AS Role FROM sc)
, st AS (SELECT 'Day0_Context' AS Stage, * FROM rl UNION ALL SELECT 'Day7_FullUpdated', * FROM rl WHERE d7 > 0)"""


def external(t: Tables):
    return V.external_roles(V.scenario_rows(t["facts"]), 1998, 1999, 2001)


def both_tasks(rows, keys, keep):
    """Metrics of both tasks in one long table: (task, keys, metric, value)."""
    out, packed = None, V.frames(rows, keep)
    for classify in (False, True):
        predictions = stored(V.evaluate(rows, classify, keep, packed=packed))  # every kind of metric reads them
        table = V.metrics(predictions, classify, keys)
        values = [c for c in table.columns if c not in keys]
        part = unpivot(table, keys, values, "Metric", "Value").withColumn("Task", F.lit("Classification" if classify else "Regression"))
        out = part if out is None else out.unionByName(part)
    return out


@query("mod11_external_by_year")
def _(t):
    long = both_tasks(external(t), ["Stage", "Model", "ExternalValidationYear"], ["ExternalValidationYear"])
    keys = ["Stage", "Model", "ExternalValidationYear", "Task"]
    counted = long.where("Metric = 'RowCount' AND Value >= 2").select(*keys)
    return long.join(counted, keys, "left_semi")


@query("mod11_unseen_groups")
def _(t):
    rows = V.scenario_rows(t["facts"])
    out = None
    for scenario in V.UNSEEN:
        part = both_tasks(V.unseen_roles(rows, scenario, seed=SCENARIO_SEED), ["Stage", "Model"], []).withColumn("Scenario", F.lit(scenario))
        out = part if out is None else out.unionByName(part)
    return out


# Which rows every stage and task is judged on, and what the baselines say there.
def _baselines(t, roles, keep):
    out, packed = None, V.frames(roles, keep)
    for classify in (False, True):
        value = M.SCORE if classify else M.PREDICTED
        part = V.evaluate(roles, classify, keep, packed=packed).where(F.col("Model").startswith("Dummy")).select(
            "Stage", "Model", "testId", *keep, F.col(M.FAILED if classify else M.ACTUAL).cast("double").alias("Actual"), F.col(value).alias("Predicted")
        )
        out = part if out is None else out.unionByName(part)
    return out


_BASELINES = """, b AS (SELECT {k}Stage, avg(y) FILTER (Role = 'train') AS m, quantile_cont(y, 0.5) FILTER (Role = 'train') AS q, avg(bad) FILTER (Role = 'train') AS p FROM st GROUP BY ALL)
, o AS (SELECT st.*, m.Model, CASE WHEN m.Model = 'DummyPrior' THEN CAST(bad AS DOUBLE) ELSE y END AS Actual, CASE m.Model WHEN 'DummyMean' THEN b.m WHEN 'DummyMedian' THEN b.q ELSE b.p END AS Predicted
 FROM st JOIN b USING ({k}Stage), (VALUES ('DummyMean'), ('DummyMedian'), ('DummyPrior')) m(Model) WHERE Role = 'test')"""


@query("mod11_external_baselines", _LAB + _EXT + _BASELINES.format(k="") + f" SELECT Stage, Model, testId, CAST(yr AS INT) AS ExternalValidationYear, Actual, {R('Predicted')} FROM o")
def _(t):
    return rounded(_baselines(t, external(t), ["ExternalValidationYear"]))


@query("mod11_unseen_baselines", _LAB + _UNSEEN + _BASELINES.format(k="Scenario, ") + f" SELECT Scenario, Stage, Model, testId, Actual, {R('Predicted')} FROM o")
def _(t):
    rows = V.scenario_rows(t["facts"])
    out = None
    for scenario in V.UNSEEN:
        part = _baselines(t, V.unseen_roles(rows, scenario, seed=SCENARIO_SEED), []).withColumn("Scenario", F.lit(scenario))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("mod11_unseen_split_summary", _LAB + _UNSEEN + """, x AS (SELECT Scenario, count(*) AS RowsAfterContextFilter, count(*) FILTER (Role = 'train') AS TrainRows, count(*) FILTER (Role = 'test') AS TestRows,
 count(DISTINCT ScenarioGroup) FILTER (Role = 'train') AS TrainGroups, count(DISTINCT ScenarioGroup) FILTER (Role = 'test') AS TestGroups FROM rl GROUP BY 1)
SELECT x.*, (SELECT count(*) FROM ctx) AS RowsBeforeContextFilter, (SELECT count(*) FROM ctx) - RowsAfterContextFilter AS RowsExcludedForMissingContext,
 (SELECT count(*) FROM (SELECT ScenarioGroup FROM rl WHERE rl.Scenario = x.Scenario AND Role = 'train' INTERSECT SELECT ScenarioGroup FROM rl WHERE rl.Scenario = x.Scenario AND Role = 'test')) AS OverlappingGroups FROM x""")
def _(t):
    rows = V.scenario_rows(t["facts"])
    out = None
    for scenario in V.UNSEEN:
        part = V.split_summary(rows, V.unseen_roles(rows, scenario, seed=SCENARIO_SEED), scenario)
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- surrogates and recipe search
#: A strength that follows the recipe; the stand-in's own does not, and no search would be allowed.
_RECIPE_STRENGTH = "1500 + 5 * CalcCementContent_lbs_yd3 + 2 * FlyAshContent_lbs_yd3 - 1500 * calcWCRatio + CAST(testId * 37 % 800 AS DOUBLE)"


def recipes(t: Tables):
    cohort = C.recipe_cohort(t["facts"]).withColumn("SplitGroup", E.project_group("projectId", "testId"))
    cohort = cohort.withColumn(S.TARGET, F.expr(_RECIPE_STRENGTH))
    return P.train_test(cohort, "SplitGroup").withColumn("Role", F.col("DatasetSplit"))


@query("mod12_mix_surrogates")
def _(t):
    return U.train(durable(recipes(t)))[0]


@query("sel08_mod12_surrogate_recipe_search")
def _(t):
    rows = durable(recipes(t))
    _, best = U.train(rows, {"strength28": S.TARGET}, boosting=ROUNDS, forest=TREES)
    found = U.find_recipes(rows, best, U.Search(wc_max=0.8, objective="total_cementitious"))
    return found.select("testId", *S.RECIPE_CORE, "TotalCementitiousContent_lbs_yd3", "PredictedStrength28_psi", "ConservativeStrength28_psi")
