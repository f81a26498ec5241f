"""Queries for splits, encoding, metrics and decision analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import clean as C
from pourstat.operators import decide as D
from pourstat.operators import encode as N
from pourstat.operators import metrics as M
from pourstat.operators import profile as P
from pourstat.operators import splits as L
from pourstat.workload.clean_queries import _CAT, _band
from pourstat.workload.profile_queries import union
from pourstat.workload.registry import R, RS, Tables, query, rounded
from pourstat.workload.standins import cte

GROUP_SQL = "coalesce(nullif(trim(CAST(projectId AS VARCHAR)), ''), 'MISSING_PROJECT_TEST_' || CAST(testId AS VARCHAR))"


def bucket(seed: int, key: str = "SplitGroup") -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT % 100"


SPLIT = f", g AS (SELECT *, {GROUP_SQL} AS SplitGroup FROM facts), sp AS (SELECT *, CASE WHEN {bucket(42)} < 20 THEN 'test' ELSE 'train' END AS DatasetSplit FROM g)"


def grouped(t: Tables):
    return t["facts"].withColumn("SplitGroup", E.project_group("projectId", "testId"))


@query("spl01_group_split", cte("facts") + SPLIT + " SELECT testId, SplitGroup, DatasetSplit FROM sp")
def _(t):
    return L.train_test(grouped(t), "SplitGroup").select("testId", "SplitGroup", "DatasetSplit")


@query("spl02_three_way_split", cte("facts") + SPLIT + f""" SELECT testId, SplitGroup, CASE WHEN {bucket(42)} < 20 THEN 'test' WHEN {bucket(43)} < 20 THEN 'validation' ELSE 'train' END AS DatasetSplit FROM g""")
def _(t):
    return L.train_validation_test(grouped(t), "SplitGroup").select("testId", "SplitGroup", "DatasetSplit")


@query("grp31_split_summary", cte("facts") + SPLIT + f"""
SELECT DatasetSplit, count(*) AS RowCount, count(DISTINCT SplitGroup) AS UniqueGroups, {R(f'avg({S.TARGET})', 'TargetMean')}, {R(f'stddev_samp({S.TARGET})', 'TargetStd')},
 min({S.TARGET}) AS TargetMin, max({S.TARGET}) AS TargetMax, {R(f'quantile_cont({S.TARGET}, 0.5)', 'TargetMedian')} FROM sp GROUP BY 1""")
def _(t):
    return rounded(P.target_summary(L.train_test(grouped(t), "SplitGroup"), ["DatasetSplit"], S.TARGET, "SplitGroup"))


# Rows are split one by one here, so groups do fall on both sides.
@query("set03_joi14_split_overlap", cte("facts") + SPLIT + f"""
, rw AS (SELECT SplitGroup, CASE WHEN {bucket(42, "CAST(testId AS VARCHAR)")} < 20 THEN 'test' ELSE 'train' END AS DatasetSplit FROM g)
SELECT SplitGroup FROM rw WHERE DatasetSplit = 'train' INTERSECT SELECT SplitGroup FROM rw WHERE DatasetSplit = 'test'""")
def _(t):
    split = L.train_test(grouped(t).withColumn("_row", F.col("testId").cast("string")), "_row")
    return L.shared_keys(split.where("DatasetSplit = 'train'"), split.where("DatasetSplit = 'test'"), "SplitGroup")


FOLDS = """, z AS (SELECT SplitGroup, count(*) AS n FROM g GROUP BY 1), pl AS (SELECT SplitGroup, row_number() OVER (ORDER BY n DESC, md5(SplitGroup), SplitGroup) - 1 AS a,
   least(5, (SELECT count(*) FROM z)) AS k FROM z)
, folds AS (SELECT SplitGroup, CAST(CASE WHEN (a // k) % 2 = 0 THEN a % k + 1 ELSE k - a % k END AS INT) AS Fold FROM pl), fd AS (SELECT g.*, folds.Fold FROM g JOIN folds USING (SplitGroup))"""


@query("spl03_group_folds", cte("facts") + SPLIT + FOLDS + " SELECT testId, SplitGroup, Fold FROM fd")
def _(t):
    return L.with_folds(grouped(t), "SplitGroup").select("testId", "SplitGroup", "Fold")


@query("grp45_fold_membership", cte("facts") + SPLIT + FOLDS + " SELECT Fold, SplitGroup, count(*) AS RowCount FROM fd GROUP BY 1, 2")
def _(t):
    return L.group_membership(L.with_folds(grouped(t), "SplitGroup"), ["Fold"], "SplitGroup")


@query("grp31_fold_summary", cte("facts") + SPLIT + FOLDS + f"""
SELECT Fold, count(*) AS RowCount, count(DISTINCT SplitGroup) AS UniqueGroups, {R(f'avg({S.TARGET})', 'TargetMean')}, {R(f'stddev_pop({S.TARGET})', 'TargetStd')},
 min({S.TARGET}) AS TargetMin, max({S.TARGET}) AS TargetMax, {R(f'quantile_cont({S.TARGET}, 0.5)', 'TargetMedian')} FROM fd GROUP BY 1""")
def _(t):
    return rounded(P.target_summary(L.with_folds(grouped(t), "SplitGroup"), ["Fold"], S.TARGET, "SplitGroup", population=True))


CONTEXT = f""", cx AS (SELECT *, {_CAT.format(c='SupplierName')} AS SupplierCategory, {_CAT.format(c='plantNumber')} AS PlantCategory, {_CAT.format(c='mixNumber')} AS MixCategory FROM g)
, ctx AS (SELECT *, SupplierCategory || '|' || PlantCategory AS SupplierPlantCategory, SupplierCategory || '|' || PlantCategory || '|' || MixCategory AS SupplierPlantMixCategory FROM cx)"""


def context(t: Tables):
    return N.with_context(grouped(t), "SupplierName", "plantNumber", "mixNumber")


@query("prj33_context_categories", cte("facts") + SPLIT + CONTEXT + f" SELECT testId, {', '.join(N.CONTEXT)} FROM ctx")
def _(t):
    return context(t).select("testId", *N.CONTEXT)


@query("spl04_prj49_unseen_groups", cte("facts") + SPLIT + CONTEXT + f"""
, sc AS (SELECT 'UnseenSupplier' AS Scenario, testId, SupplierCategory AS SplitGroup FROM ctx WHERE SupplierCategory <> '__MISSING__' UNION ALL
 SELECT 'UnseenSupplierPlantMix', testId, SupplierPlantMixCategory FROM ctx WHERE SupplierCategory <> '__MISSING__' AND PlantCategory <> '__MISSING__' AND MixCategory <> '__MISSING__')
SELECT Scenario, testId, SplitGroup AS ScenarioGroup, CASE WHEN {bucket(42)} < 20 THEN 'test' ELSE 'train' END AS DatasetSplit FROM sc""")
def _(t):
    parts = [
        L.train_test(L.scenario_rows(context(t), s), "ScenarioGroup").select(
            F.lit(s).alias("Scenario"), "testId", "ScenarioGroup", "DatasetSplit"
        )
        for s in ("UnseenSupplier", "UnseenSupplierPlantMix")
    ]
    return parts[0].unionByName(parts[1])


@query("spl05_temporal_split", cte("facts") + """
, a AS (SELECT testId, 'train' AS DatasetSplit FROM facts WHERE year(castDate) <= 1998), b AS (SELECT testId, 'external' AS DatasetSplit FROM facts WHERE year(castDate) BETWEEN 1999 AND 2001)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE testId NOT IN (SELECT testId FROM a)""")
def _(t):
    train = C.until_year(t["facts"], 1998)
    external = C.between_years(t["facts"], 1999, 2001)
    L.assert_disjoint(train, external, "testId")
    return train.select("testId", F.lit("train").alias("DatasetSplit")).unionByName(
        external.select("testId", F.lit("external").alias("DatasetSplit"))
    )


_FIELD, _BATCH = ["EffectiveSlump_in", "EffectiveAir_percent"], S.RECIPE_CORE


@query("spl06_cohort_effects", cte("facts") + SPLIT + f"""
, k AS (SELECT *, {' AND '.join(c + ' IS NOT NULL' for c in [S.TARGET, 'projectId', *_FIELD, *_BATCH])} AS complete FROM sp WHERE {S.TARGET} IS NOT NULL)
SELECT 'all' AS Cohort, DatasetSplit, count(*) AS RowCount, count(DISTINCT SplitGroup) AS UniqueGroups FROM k GROUP BY 2 UNION ALL
SELECT 'split_then_filter', DatasetSplit, count(*), count(DISTINCT SplitGroup) FROM k WHERE complete GROUP BY 2 UNION ALL
SELECT 'filter_then_split', CASE WHEN {bucket(7)} < 20 THEN 'test' ELSE 'train' END, count(*), count(DISTINCT SplitGroup) FROM k WHERE complete GROUP BY 2""")
def _(t):
    rows = L.cohorts(grouped(t), _FIELD, _BATCH).where("AllStrength = 1")
    split = L.train_test(rows, "SplitGroup")
    complete = F.col("CompleteCase") == 1
    variants = {
        "all": split,
        "split_then_filter": split.where(complete),
        "filter_then_split": L.train_test(rows.where(complete), "SplitGroup", seed=7),
    }
    out = None
    for name, df in variants.items():
        part = df.groupBy(F.lit(name).alias("Cohort"), "DatasetSplit").agg(
            F.count(F.lit(1)).alias("RowCount"), F.count_distinct("SplitGroup").alias("UniqueGroups")
        )
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- encoding
@query("enc01_smoothed_means", cte("facts") + SPLIT + CONTEXT + f"""
SELECT SupplierCategory, count({S.TARGET}) AS RowCount, {R(f'(sum({S.TARGET}) + 20.0::DOUBLE * (SELECT avg({S.TARGET}) FROM ctx)) / (count({S.TARGET}) + 20)', 'SmoothedMean')} FROM ctx GROUP BY 1""")
def _(t):
    return rounded(N.smoothed_means(context(t), "SupplierCategory", S.TARGET))


_ENC = ["SupplierCategory", "SupplierPlantMixCategory"]


def _enc_sql(y: str) -> str:
    base = cte("facts") + SPLIT + FOLDS + CONTEXT.replace("FROM g)", "FROM fd)") + f"""
, r AS (SELECT *, {y} AS y, CASE WHEN Fold = 2 THEN 'test' ELSE 'train' END AS Role FROM ctx WHERE {S.TARGET} IS NOT NULL AND {S.REQUIRED} IS NOT NULL)
, mu AS (SELECT avg(y) AS m FROM r WHERE Role = 'train')"""
    for i, c in enumerate(_ENC):
        base += f"""
, o{i} AS (SELECT {c}, Fold, sum(y) AS s, count(y) AS n FROM r WHERE Role = 'train' GROUP BY 1, 2), a{i} AS (SELECT {c}, sum(y) AS s, count(y) AS n FROM r WHERE Role = 'train' GROUP BY 1)"""
    sel = ", ".join(
        R(f"CASE WHEN r.Role = 'train' THEN (a{i}.s - o{i}.s + 20 * m) / (a{i}.n - o{i}.n + 20) ELSE (coalesce(a{i}.s, 0) + 20 * m) / (coalesce(a{i}.n, 0) + 20) END", f"{c}_TargetMean")
        + f", {R(f'ln(1 + coalesce(a{i}.n, 0))', c + '_LogCount')}, CASE WHEN a{i}.n IS NULL THEN 1 ELSE 0 END AS {c}_Unknown"
        for i, c in enumerate(_ENC)
    )
    joins = " ".join(
        f"LEFT JOIN o{i} ON o{i}.{c} = r.{c} AND o{i}.Fold = r.Fold LEFT JOIN a{i} ON a{i}.{c} = r.{c}" for i, c in enumerate(_ENC)
    )
    return base + f" SELECT r.testId, r.Role, {sel} FROM r CROSS JOIN mu {joins}"


def _encoded(t: Tables, y: str):
    df = L.with_folds(grouped(t), "SplitGroup")
    df = N.with_context(df, "SupplierName", "plantNumber", "mixNumber")
    df = df.where(F.col(S.TARGET).isNotNull() & F.col(S.REQUIRED).isNotNull())
    df = L.fold_roles(C.with_recomputed_failure(df), 2)
    out = N.cross_fitted_encode(df, _ENC, y, "Fold")
    return rounded(out.select("testId", "Role", *[f"{c}_{n}" for c in _ENC for n in ("TargetMean", "LogCount", "Unknown")]))


@query("enc02_04_cross_fitted_encoding", _enc_sql(S.TARGET))
def _(t):
    return _encoded(t, S.TARGET)


@query("enc03_failure_rate_encoding", _enc_sql(f"CAST({S.TARGET} < {S.REQUIRED} AS INT)"))
def _(t):
    return _encoded(t, S.FAILURE)


META = ", u AS (" + union(f"SELECT '{c}' AS ContextColumn, {c} AS v, Fold FROM ctx" for c in N.CONTEXT) + """)
, c1 AS (SELECT ContextColumn, v, Fold, count(*) AS n FROM u GROUP BY 1, 2, 3), c2 AS (SELECT *, n = sum(n) OVER (PARTITION BY ContextColumn, v) AS only_here FROM c1)
, md AS (SELECT ContextColumn, Fold, count(*) AS ValidationUniqueCategories, CAST(sum(CASE WHEN only_here THEN n ELSE 0 END) AS BIGINT) AS UnknownValidationRows,
   (SELECT count(DISTINCT v) FROM u WHERE u.ContextColumn = c2.ContextColumn) - count(CASE WHEN only_here THEN 1 END) AS TrainUniqueCategories,
   sum(CASE WHEN only_here THEN n ELSE 0 END) / sum(n) * 100.0::DOUBLE AS UnknownValidationPercent FROM c2 GROUP BY 1, 2)"""
_META_BASE = cte("facts") + SPLIT + FOLDS + CONTEXT.replace("FROM g)", "FROM fd)") + META


def metadata(t: Tables):
    df = N.with_context(L.with_folds(grouped(t), "SplitGroup"), "SupplierName", "plantNumber", "mixNumber")
    return N.encoding_metadata(df, N.CONTEXT)


@query("enc05_encoding_metadata", _META_BASE + f" SELECT * EXCLUDE (UnknownValidationPercent), {R('UnknownValidationPercent')} FROM md")
def _(t):
    return rounded(metadata(t))


@query("grp43_context_coverage", _META_BASE + f"""
SELECT ContextColumn, {R('avg(UnknownValidationPercent)', 'MeanUnknownValidationPercent')}, {R('max(UnknownValidationPercent)', 'MaxUnknownValidationPercent')},
 {R('avg(TrainUniqueCategories)', 'MeanTrainUniqueCategories')} FROM md GROUP BY 1""")
def _(t):
    return rounded(N.context_coverage(metadata(t)))


# ---------------------------------------------------------------- exact preprocessing
_IMP = ["EffectiveSlump_in", "EffectiveAir_percent", "WaterAdded_gal_per_yd3"]
ROLE = SPLIT + ", rl AS (SELECT *, DatasetSplit AS Role FROM sp)"


def roles(t: Tables):
    return L.train_test(grouped(t), "SplitGroup").withColumn("Role", F.col("DatasetSplit"))


@query("mod01_median_imputation", cte("facts") + ROLE + ", md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _IMP) + f""" FROM rl WHERE Role = 'train')
SELECT testId, {', '.join(R(f'coalesce({c}, m_{c})', c) for c in _IMP)}, {', '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_WasMissing' for c in _IMP)} FROM rl, md""")
def _(t):
    return rounded(N.impute_medians(roles(t), _IMP).select("testId", *_IMP, *[f"{c}_WasMissing" for c in _IMP]))


@query("mod02_standardisation", cte("facts") + ROLE + ", md AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _IMP) + f""" FROM rl WHERE Role = 'train')
SELECT testId, {', '.join(R(f'({c} - m_{c}) / s_{c}', c + '_Scaled') for c in _IMP)} FROM rl, md""")
def _(t):
    return rounded(N.standardize(roles(t), _IMP).select("testId", *[f"{c}_Scaled" for c in _IMP]))


@query("mod03_baselines", cte("facts") + ROLE + f""", f AS (SELECT *, CASE WHEN {S.TARGET} IS NULL OR {S.REQUIRED} IS NULL THEN NULL ELSE CAST({S.TARGET} < {S.REQUIRED} AS INT) END AS y FROM rl)
, md AS (SELECT avg({S.TARGET}) AS m, quantile_cont({S.TARGET}, 0.5) AS q, avg(y) AS p FROM f WHERE Role = 'train')
SELECT testId, {R('m', 'DummyMean')}, {R('q', 'DummyMedian')}, {R('p', 'DummyPrior')} FROM f, md WHERE Role = 'test'""")
def _(t):
    df = N.baseline_predictions(C.with_recomputed_failure(roles(t)), S.TARGET, S.FAILURE)
    return rounded(df.select("testId", "DummyMean", "DummyMedian", "DummyPrior"))


@query("mod08_class_weights", cte("facts") + f""", f AS (SELECT testId, CAST({S.TARGET} < {S.REQUIRED} AS INT) AS y FROM facts), c AS (SELECT count(CASE WHEN y = 0 THEN 1 END) AS a, count(CASE WHEN y = 1 THEN 1 END) AS b FROM f)
SELECT testId, y AS FailureFlag28, {R('CASE WHEN y = 1 THEN (a + b) / (2.0::DOUBLE * b) WHEN y = 0 THEN (a + b) / (2.0::DOUBLE * a) END', 'ClassWeight')} FROM f, c""")
def _(t):
    return rounded(N.class_weights(C.with_recomputed_failure(t["facts"]), S.FAILURE).select("testId", S.FAILURE, "ClassWeight"))


# ---------------------------------------------------------------- metrics
PR = cte("predictions") + """, e AS (SELECT *, ActualStrength28_psi AS y, PredictedStrength28_psi - ActualStrength28_psi AS r, abs(PredictedStrength28_psi - ActualStrength28_psi) AS a,
   ActualFailureFlag AS f, FailureProbability AS p, PredictedStrength28_psi - RequiredStrength28_psi AS m FROM predictions)"""
REG = f"""count(*) AS RowCount, {R('avg(a)', 'MAE')}, {R('sqrt(avg(r * r))', 'RMSE')}, {R('1 - sum(r * r) / (var_pop(y) * count(*))', 'R2')}, {R('avg(r)', 'MeanBias')},
 {R('100.0 * count(CASE WHEN a <= 300 THEN 1 END) / count(*)', 'Within300PsiPercent')}, {R('100.0 * count(CASE WHEN a <= 500 THEN 1 END) / count(*)', 'Within500PsiPercent')},
 {R('quantile_cont(a, 0.5)', 'MedianAE')}, {R('quantile_cont(a, 0.9)', 'P90AbsoluteError')}"""
KEYS = ["FeatureSet", "Model"]


@query("prj44_residuals", PR + f" SELECT testId, Model, FeatureSet, {R('r', 'ResidualPsi')}, {R('a', 'AbsoluteErrorPsi')}, CAST(a <= 300 AS INT) AS Within300Psi, CAST(a <= 500 AS INT) AS Within500Psi FROM e")
def _(t):
    return rounded(M.with_residuals(t["predictions"]).select("testId", *reversed(KEYS), "ResidualPsi", "AbsoluteErrorPsi", "Within300Psi", "Within500Psi"))


@query("grp38_regression_metrics", PR + f" SELECT FeatureSet, Model, Fold, {REG} FROM e GROUP BY 1, 2, 3")
def _(t):
    return rounded(M.regression_metrics(t["predictions"], [*KEYS, "Fold"]))


@query("grp39_metrics_by_year", PR + f" SELECT FeatureSet, Model, castYear, {REG} FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def _(t):
    return rounded(M.yearly(M.regression_metrics(t["predictions"], [*KEYS, "castYear"])))


@query("grp39_metrics_by_band", PR + f" SELECT FeatureSet, Model, {_band('y', C.STRENGTH_EDGES, C.STRENGTH_LABELS, False)} AS StrengthBand, count(*) AS RowCount, {R('avg(a)', 'MAE')}, {R('avg(r)', 'MeanBias')} FROM e GROUP BY 1, 2, 3")
def _(t):
    return rounded(M.band_metrics(t["predictions"], KEYS))


@query("grp39_error_by_range", PR + f""" SELECT {_band('y', C.ERROR_EDGES, C.interval_labels(C.ERROR_EDGES, True), True)} AS StrengthRange, count(*) AS TestCount, {R('avg(a)', 'MAE')}, {R('avg(y)', 'ActualMean')},
 {R('avg(PredictedStrength28_psi)', 'PredictedMean')}, {R('quantile_cont(a, 0.5)', 'MedianError')} FROM e GROUP BY 1""")
def _(t):
    return rounded(M.error_by_range(t["predictions"]))


def _cm(flag: str) -> str:
    return f"""count(CASE WHEN f = 1 AND {flag} THEN 1 END) AS TruePositives, count(CASE WHEN f = 0 AND {flag} THEN 1 END) AS FalsePositives,
 count(CASE WHEN f = 1 AND NOT {flag} THEN 1 END) AS FalseNegatives, count(CASE WHEN f = 0 AND NOT {flag} THEN 1 END) AS TrueNegatives"""


RATES = f"""{R('coalesce(TruePositives / nullif(TruePositives + FalseNegatives, 0), 0)', 'Recall')}, {R('coalesce(TruePositives / nullif(TruePositives + FalsePositives, 0), 0)', 'Precision')},
 {R('coalesce(2 * TruePositives / nullif(2 * TruePositives + FalsePositives + FalseNegatives, 0), 0)', 'F1')}"""


def _class_sql(keys: str, having: str = "") -> str:
    return f""", q AS (SELECT {keys}, count(*) AS RowCount, 100.0::DOUBLE * avg(f) AS fr, avg((p - f) * (p - f)) AS bs, {_cm('p >= 0.3')} FROM e GROUP BY {keys} {having})
SELECT {keys}, RowCount, {R('fr', 'FailureRatePercent')}, {R('bs', 'BrierScore')}, TruePositives, FalsePositives, FalseNegatives, TrueNegatives, {RATES}, CAST(0.3 AS DOUBLE) AS Threshold FROM q"""


@query("grp40_threshold_metrics", PR + _class_sql("FeatureSet, Model, Fold"))
def _(t):
    return rounded(M.threshold_metrics(t["predictions"], [*KEYS, "Fold"], 0.3))


@query("grp39_class_metrics_by_year", PR + _class_sql("FeatureSet, Model, castYear", "HAVING count(*) >= 2"))
def _(t):
    return rounded(M.yearly(M.threshold_metrics(t["predictions"], [*KEYS, "castYear"], 0.3)))


CUM = """, s AS (SELECT FeatureSet, Model, p, count(*) AS n, count(CASE WHEN f = 1 THEN 1 END) AS pos FROM e GROUP BY 1, 2, 3)
, w AS (SELECT *, sum(n) OVER o AS nu, sum(pos) OVER o AS pu, sum(n) OVER g AS nt, sum(pos) OVER g AS pt FROM s WINDOW o AS (PARTITION BY FeatureSet, Model ORDER BY p DESC), g AS (PARTITION BY FeatureSet, Model))"""


@query("grp41_ranking_metrics", PR + CUM + f""" SELECT FeatureSet, Model, {R('sum(pos / pt * pu / nu)', 'AveragePrecision_PR_AUC')},
 {R('sum(pos * ((nt - pt) - (nu - pu) + 0.5 * (n - pos))) / max(pt * (nt - pt))', 'ROC_AUC')} FROM w GROUP BY 1, 2""")
def _(t):
    return rounded(M.ranking_metrics(t["predictions"], KEYS))


@query("win12_cumulative_positives", PR + CUM + """ SELECT FeatureSet, Model, p AS FailureProbability, pos, n, CAST(pu AS BIGINT) AS pos_upto, CAST(nu AS BIGINT) AS n_upto, CAST(pt AS BIGINT) AS pos_total, CAST(nt AS BIGINT) AS n_total FROM w""")
def _(t):
    return M.score_sums(t["predictions"], KEYS)


FOLD_METRICS = PR + """, fm AS (SELECT FeatureSet, Model, Fold, count(*) AS RowCount, avg(a) AS MAE, sqrt(avg(r * r)) AS RMSE, 1 - sum(r * r) / (var_pop(y) * count(*)) AS R2, quantile_cont(a, 0.5) AS MedianAE FROM e GROUP BY 1, 2, 3)"""


def _cv(m: str, dev: str) -> str:
    best, worst = ("max", "min") if m == "R2" else ("min", "max")
    return f"{R(f'avg({m})', 'MeanCV_' + m)}, {R(f'{dev}({m})', 'StdCV_' + m)}, {R(f'{best}({m})', 'BestFold_' + m)}, {R(f'{worst}({m})', 'WorstFold_' + m)}"


_CVM = ["MAE", "RMSE", "R2", "MedianAE"]


def fold_metrics(t: Tables, quantiles: bool = False):
    return M.regression_metrics(t["predictions"], [*KEYS, "Fold"], quantiles=quantiles)


@query("grp42_cv_summary", FOLD_METRICS + f" SELECT FeatureSet, Model, count(*) AS FoldCount, CAST(sum(RowCount) AS BIGINT) AS TotalValidationRows, {', '.join(_cv(m, 'stddev_samp') for m in _CVM)} FROM fm GROUP BY 1, 2")
def _(t):
    return rounded(M.cv_summary(fold_metrics(t, True), KEYS, _CVM))


@query("grp42_cv_summary_population", FOLD_METRICS + f" SELECT FeatureSet, Model, count(*) AS FoldCount, CAST(sum(RowCount) AS BIGINT) AS TotalValidationRows, {', '.join(_cv(m, 'stddev_pop') for m in _CVM)} FROM fm GROUP BY 1, 2")
def _(t):
    return rounded(M.cv_summary(fold_metrics(t, True), KEYS, _CVM, population=True))


SUMMARY = FOLD_METRICS + """, sm AS (SELECT FeatureSet, Model, avg(MAE) AS MeanCV_MAE, stddev_samp(MAE) AS StdCV_MAE, max(MAE) - min(MAE) AS MAE_Range, avg(RMSE) AS MeanCV_RMSE, avg(R2) AS MeanCV_R2 FROM fm GROUP BY 1, 2)"""


@query("win11_cv_rank_stability", SUMMARY + f""" SELECT CAST(row_number() OVER (ORDER BY MeanCV_MAE, StdCV_MAE, MeanCV_RMSE, FeatureSet, Model) AS INT) AS CV_Rank, FeatureSet, Model, {RS('MeanCV_MAE', 'MAE_Range')},
 {R('StdCV_MAE / MeanCV_MAE * 100', 'MAE_CV_Percent')} FROM sm""")
def _(t):
    summary = M.with_stability(M.cv_summary(fold_metrics(t), KEYS, ["MAE", "RMSE"]))
    order = [F.asc("MeanCV_MAE"), F.asc("StdCV_MAE"), F.asc("MeanCV_RMSE"), F.asc("FeatureSet"), F.asc("Model")]
    from pyspark.sql import Window

    # One row per model: a few rows in one partition.
    ranked = summary.withColumn("CV_Rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return rounded(ranked.select("CV_Rank", *KEYS, "MeanCV_MAE", "MAE_Range", "MAE_CV_Percent"))


BEST = SUMMARY + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY FeatureSet ORDER BY MeanCV_MAE, MeanCV_RMSE, Model) AS rn FROM sm) WHERE rn = 1)"""


def best_models(t: Tables):
    summary = M.cv_summary(fold_metrics(t), KEYS, ["MAE", "RMSE", "R2"])
    return D.best_model(summary, ["FeatureSet"], [F.asc("MeanCV_MAE"), F.asc("MeanCV_RMSE")])


@query("win06_best_model", BEST + f" SELECT FeatureSet, Model, {RS('MeanCV_MAE', 'MeanCV_RMSE', 'MeanCV_R2')} FROM best")
def _(t):
    return rounded(best_models(t).select(*KEYS, "MeanCV_MAE", "MeanCV_RMSE", "MeanCV_R2"))


@query("joi15_best_model_rows", BEST + " SELECT e.testId, e.FeatureSet, e.Model, e.Fold FROM e JOIN best USING (FeatureSet, Model)")
def _(t):
    return D.keep_best_models(t["predictions"], best_models(t)).select("testId", *KEYS, "Fold")


@query("win09_largest_errors", PR + f""" SELECT FeatureSet, Model, testId, {R('a', 'AbsoluteErrorPsi')} FROM (SELECT *, row_number() OVER (PARTITION BY FeatureSet, Model ORDER BY a DESC, testId) AS rn FROM e) WHERE rn <= 25""")
def _(t):
    from pourstat.operators.order_stats import top_rows

    rows = M.with_residuals(t["predictions"])
    return rounded(top_rows(rows, KEYS, [F.desc("AbsoluteErrorPsi"), F.asc("testId")], 25).select(*KEYS, "testId", "AbsoluteErrorPsi"))


@query("srt02_largest_errors_overall", PR + f" SELECT FeatureSet, Model, testId, {R('a', 'AbsoluteErrorPsi')} FROM e ORDER BY a DESC, testId, FeatureSet, Model LIMIT 50")
def _(t):
    rows = M.with_residuals(t["predictions"]).orderBy(F.desc("AbsoluteErrorPsi"), "testId", *KEYS).limit(50)
    return rounded(rows.select(*KEYS, "testId", "AbsoluteErrorPsi"))


@query("srt03_mixed_direction_sort", PR + " SELECT FeatureSet, Model, Fold, count(*) AS RowCount, min(p) AS lo FROM e GROUP BY 1, 2, 3 ORDER BY FeatureSet ASC, RowCount DESC, lo ASC NULLS LAST, Model, Fold")
def _(t):
    counts = t["predictions"].groupBy(*KEYS, "Fold").agg(F.count(F.lit(1)).alias("RowCount"), F.min(M.SCORE).alias("lo"))
    return counts.orderBy(F.asc("FeatureSet"), F.desc("RowCount"), F.asc_nulls_last("lo"), "Model", "Fold")


# ---------------------------------------------------------------- decisions
ALIGNED = BEST + """, al AS (SELECT reg.testId, reg.Fold, reg.FeatureSet, reg.m, clf.f, clf.p FROM (SELECT e.* FROM e JOIN best USING (FeatureSet, Model)) reg
 JOIN (SELECT * FROM e WHERE Model = 'B') clf ON clf.Fold = reg.Fold AND clf.FeatureSet = reg.FeatureSet AND clf.testId = reg.testId)"""


def aligned(t: Tables):
    predictions = t["predictions"]
    return D.align_predictions(D.keep_best_models(predictions, best_models(t)), predictions.where("Model = 'B'"))


@query("joi11_aligned_predictions", ALIGNED + f" SELECT testId, Fold, FeatureSet, {R('m', 'PredictedMargin_psi')}, f AS ActualFailureFlag, p AS FailureProbability FROM al")
def _(t):
    return rounded(aligned(t).select("testId", "Fold", "FeatureSet", "PredictedMargin_psi", M.FAILED, M.SCORE))


@query("joi09_one_to_one_merge", cte("facts") + f"""
, a AS (SELECT testId, {S.TARGET} FROM facts WHERE {S.TARGET} IS NOT NULL), b AS (SELECT testId, {S.REQUIRED} FROM facts WHERE {S.REQUIRED} IS NOT NULL)
SELECT * FROM a JOIN b USING (testId)""")
def _(t):
    one = t["facts"].where(F.col(S.TARGET).isNotNull()).select("testId", S.TARGET)
    two = t["facts"].where(F.col(S.REQUIRED).isNotNull()).select("testId", S.REQUIRED)
    return D.merge_one_to_one(one, two, ["testId"])


@query("joi09_10_checked_merges", cte("facts", "predictions") + f""" SELECT p.testId, p.Model, r.{S.REQUIRED} FROM predictions p JOIN facts r ON r.testId = p.testId WHERE p.FeatureSet = 'Day0_Context' AND r.{S.REQUIRED} IS NOT NULL""")
def _(t):
    known = t["facts"].where(F.col(S.REQUIRED).isNotNull()).select("testId", S.REQUIRED)
    rows = t["predictions"].where("FeatureSet = 'Day0_Context'").join(known.select("testId"), "testId", "left_semi")
    return D.merge_many_to_one(rows, known, ["testId"], S.REQUIRED).select("testId", "Model", S.REQUIRED)


SWEEP = ALIGNED + f""", mt AS (SELECT CAST(x AS DOUBLE) AS t FROM range(-500, 1501, 50) r(x)), pt AS (SELECT x / 1000.0::DOUBLE AS t FROM range(50, 951, 25) r(x))
, s0 AS (SELECT FeatureSet, 'RegressionMargin' AS Method, t AS Threshold, 'psi' AS ThresholdUnit, {_cm('m <= t')} FROM al, mt GROUP BY FeatureSet, t UNION ALL
 SELECT FeatureSet, 'DirectClassifier', t, 'probability', {_cm('p >= t')} FROM al, pt GROUP BY FeatureSet, t)
, sw AS (SELECT *, coalesce(TruePositives / nullif(TruePositives + FalseNegatives, 0), 0) AS Recall, coalesce(TruePositives / nullif(TruePositives + FalsePositives, 0), 0) AS "Precision",
   coalesce(2 * TruePositives / nullif(2 * TruePositives + FalsePositives + FalseNegatives, 0), 0) AS F1 FROM s0)"""
_SW = f'FeatureSet, Method, Threshold, {R("Recall")}, round("Precision", 6) AS "Precision", {R("F1")}, FalseNegatives, FalsePositives'


def swept(t: Tables):
    return D.full_sweep(aligned(t))


@query("sel02_joi16_threshold_sweep", SWEEP + f" SELECT {_SW}, TruePositives, TrueNegatives, ThresholdUnit FROM sw")
def _(t):
    return rounded(swept(t))


RECALL = """, tg AS (SELECT CAST(x AS DOUBLE) / 100 AS MinimumRecallTarget FROM (VALUES (80), (85), (90), (95)) v(x))
, el AS (SELECT sw.*, MinimumRecallTarget FROM sw, tg WHERE Recall >= MinimumRecallTarget)"""


@query("sel03_best_at_recall", SWEEP + RECALL + f""" SELECT MinimumRecallTarget, {_SW} FROM (SELECT *, row_number() OVER (PARTITION BY FeatureSet, Method, MinimumRecallTarget ORDER BY "Precision" DESC, FalsePositives, Threshold) AS rn FROM el) WHERE rn = 1""")
def _(t):
    return rounded(D.best_at_recall(swept(t), ["FeatureSet", "Method"]).drop("TruePositives", "TrueNegatives", "ThresholdUnit"))


@query("sel03_best_at_recall_by_threshold", SWEEP + RECALL + f""" SELECT MinimumRecallTarget, {_SW} FROM (SELECT *, row_number() OVER (PARTITION BY FeatureSet, Method, MinimumRecallTarget ORDER BY "Precision" DESC, Threshold DESC) AS rn FROM el) WHERE rn = 1""")
def _(t):
    return rounded(D.best_at_recall(swept(t), ["FeatureSet", "Method"], by_threshold=True).drop("TruePositives", "TrueNegatives", "ThresholdUnit"))


def _side(method: str, first: str, pre: str) -> str:
    return f"""SELECT FeatureSet, MinimumRecallTarget, Threshold AS {first}, Recall AS {pre}Recall, "Precision" AS {pre}Precision, F1 AS {pre}F1, FalseNegatives AS {pre}FalseNegatives, FalsePositives AS {pre}FalsePositives
 FROM (SELECT *, row_number() OVER (PARTITION BY FeatureSet, MinimumRecallTarget ORDER BY "Precision" DESC, FalsePositives, Threshold) AS rn FROM el WHERE Method = '{method}') WHERE rn = 1"""


@query("sel03_matched_recall", SWEEP + RECALL + f""", a AS ({_side('RegressionMargin', 'RegressionMarginThreshold_psi', 'Regression')}), b AS ({_side('DirectClassifier', 'ClassifierProbabilityThreshold', 'Classifier')})
SELECT g.FeatureSet, g.MinimumRecallTarget, RegressionMarginThreshold_psi, {RS('RegressionRecall', 'RegressionPrecision', 'RegressionF1')}, RegressionFalseNegatives, RegressionFalsePositives,
 ClassifierProbabilityThreshold, {RS('ClassifierRecall', 'ClassifierPrecision', 'ClassifierF1')}, ClassifierFalseNegatives, ClassifierFalsePositives,
 {R('ClassifierPrecision - RegressionPrecision', 'PrecisionDifference_ClassifierMinusRegression')}, ClassifierFalsePositives - RegressionFalsePositives AS FalsePositiveDifference_ClassifierMinusRegression,
 ClassifierFalseNegatives - RegressionFalseNegatives AS FalseNegativeDifference_ClassifierMinusRegression
FROM (SELECT DISTINCT FeatureSet, MinimumRecallTarget FROM sw, tg) g LEFT JOIN a ON a.FeatureSet = g.FeatureSet AND a.MinimumRecallTarget = g.MinimumRecallTarget
 LEFT JOIN b ON b.FeatureSet = g.FeatureSet AND b.MinimumRecallTarget = g.MinimumRecallTarget""")
def _(t):
    return rounded(D.matched_recall(swept(t)))


@query("sel04_best_f1", SWEEP + f""" SELECT {_SW} FROM (SELECT *, row_number() OVER (PARTITION BY FeatureSet, Method ORDER BY F1 DESC, "Precision" DESC, Threshold) AS rn FROM sw) WHERE rn = 1""")
def _(t):
    return rounded(D.best_f1(swept(t)).drop("TruePositives", "TrueNegatives", "ThresholdUnit"))


@query("sel11_precision_recall_series", SWEEP + f""" SELECT FeatureSet, Threshold, {R('Recall')}, round("Precision", 6) AS "Precision" FROM sw WHERE Method = 'DirectClassifier'""")
def _(t):
    return rounded(D.precision_recall_series(swept(t)))


@query("sel01_choose_threshold", PR + CUM + f""", c AS (SELECT FeatureSet, Model, p AS Threshold, pu / nu AS pr, pu / pt AS rc FROM w)
SELECT FeatureSet, Model, Threshold, {R('pr', 'Precision').replace('AS Precision', 'AS "Precision"')}, {R('rc', 'Recall')} FROM (SELECT *, row_number() OVER (PARTITION BY FeatureSet, Model ORDER BY CASE WHEN rc >= 0.8 THEN 0 ELSE 1 END, CASE WHEN rc >= 0.8 THEN pr ELSE rc END DESC, Threshold DESC) AS rn FROM c) WHERE rn = 1""")
def _(t):
    return rounded(D.choose_threshold(t["predictions"], KEYS))


@query("sel07_tradeoff_view", BEST + f""", th AS (SELECT CAST(x AS DOUBLE) / 1000 AS Threshold FROM (VALUES (200), (300), (400), (500), (600), (700)) v(x))
, q AS (SELECT FeatureSet, Model, Threshold, {_cm('p >= Threshold')} FROM (SELECT e.* FROM e JOIN best USING (FeatureSet, Model)), th GROUP BY 1, 2, 3)
SELECT FeatureSet, Model, Threshold, {RATES.replace("AS Precision", 'AS "Precision"')}, FalseNegatives, FalsePositives, TruePositives, TrueNegatives FROM q""")
def _(t):
    table = D.sweep(t["predictions"], KEYS, M.SCORE, S.PROBABILITY_THRESHOLDS, "DirectClassifier", "probability", False)
    return rounded(D.tradeoff_view(table, best_models(t), [0.2, 0.3, 0.4, 0.5, 0.6, 0.7]).drop("Method", "ThresholdUnit"))


def _fixed(cond: str, pre: str) -> str:
    return f"""count(CASE WHEN f = 1 AND {cond} THEN 1 END) AS {pre}TruePositives, count(CASE WHEN f = 0 AND {cond} THEN 1 END) AS {pre}FalsePositives,
 count(CASE WHEN f = 1 AND NOT {cond} THEN 1 END) AS {pre}FalseNegatives, count(CASE WHEN f = 0 AND NOT {cond} THEN 1 END) AS {pre}TrueNegatives"""


def _rate(pre: str) -> str:
    a, b, c = f"{pre}TruePositives", f"{pre}FalsePositives", f"{pre}FalseNegatives"
    return f"coalesce({a} / nullif({a} + {c}, 0), 0) AS {pre}Recall, coalesce({a} / nullif({a} + {b}, 0), 0) AS {pre}Precision, coalesce(2 * {a} / nullif(2 * {a} + {b} + {c}, 0), 0) AS {pre}F1"


def _fixed_sql(cond: str) -> str:
    names = ["Recall", "Precision", "F1"]
    return ALIGNED + f""", q AS (SELECT FeatureSet, count(*) AS "Rows", {_fixed(cond, 'Regression')}, {_fixed('p >= 0.5', 'Classifier')} FROM al GROUP BY 1), q2 AS (SELECT *, {_rate('Regression')}, {_rate('Classifier')} FROM q)
SELECT * EXCLUDE ({', '.join(s + n for s in ('Regression', 'Classifier') for n in names)}), {', '.join(R(s + n) for s in ('Regression', 'Classifier') for n in names)}, {', '.join(R(f'Classifier{n} - Regression{n}', n + 'Difference') for n in names)} FROM q2"""


@query("sel05_fixed_thresholds_margin", _fixed_sql("m <= 0.5"))
def _(t):
    return rounded(D.compare_fixed(aligned(t)))


@query("sel05_fixed_thresholds_below_required", _fixed_sql("m < 0"))
def _(t):
    return rounded(D.compare_fixed(aligned(t), strict_failure=True))


@query("grp44_agreement", ALIGNED + f""" SELECT FeatureSet, count(*) AS "Rows", {R('100.0 * count(CASE WHEN (m < 0) = (p >= 0.5) THEN 1 END) / count(*)', 'AgreementPercent')},
 {R('100.0 * count(CASE WHEN (m < 0) <> (p >= 0.5) THEN 1 END) / count(*)', 'DisagreementPercent')}, count(CASE WHEN m >= 0 AND p >= 0.5 THEN 1 END) AS ClassifierOnlyAlerts,
 count(CASE WHEN m >= 0 AND p >= 0.5 AND f = 1 THEN 1 END) AS ClassifierOnlyActualFailures, count(CASE WHEN m < 0 AND p < 0.5 THEN 1 END) AS RegressionOnlyAlerts,
 count(CASE WHEN m < 0 AND p < 0.5 AND f = 1 THEN 1 END) AS RegressionOnlyActualFailures FROM al GROUP BY 1""")
def _(t):
    return rounded(M.agreement(D.risk_flags(aligned(t)), ["FeatureSet"], "RegressionDerivedFailure", "ClassifierFailure"))


@query("sel06_improvement_table", SUMMARY + f""" SELECT a.Model, 'Day0_Context' AS BeforeVariant, 'Day7_FieldPlusRequired' AS AfterVariant, {R('a.MeanCV_MAE', 'Before_MeanCV_MAE')}, {R('a.MeanCV_R2', 'Before_MeanCV_R2')},
 {R('b.MeanCV_MAE', 'After_MeanCV_MAE')}, {R('b.MeanCV_R2', 'After_MeanCV_R2')}, {R('a.MeanCV_MAE - b.MeanCV_MAE', 'MeanCV_MAE_Improvement')}, {R('b.MeanCV_R2 - a.MeanCV_R2', 'MeanCV_R2_Improvement')}
FROM sm a JOIN sm b ON a.Model = b.Model AND a.FeatureSet = 'Day0_Context' AND b.FeatureSet = 'Day7_FieldPlusRequired'""")
def _(t):
    summary = M.cv_summary(fold_metrics(t), KEYS, ["MAE", "R2"])
    out = D.improvement(
        summary, ["Model"], "FeatureSet", "Day0_Context", "Day7_FieldPlusRequired", ["MeanCV_MAE", "MeanCV_R2"], ["MeanCV_MAE"]
    )
    return rounded(out)


_IMPACT = {"Day7": ("Day0_Context", "Day7_FieldPlusRequired")}


@query("sel06_context_impact", BEST + f""" SELECT 'Day7' AS Stage, {R('a.MeanCV_MAE', 'WithoutContext_MAE')}, {R('a.MeanCV_RMSE', 'WithoutContext_RMSE')}, {R('a.MeanCV_R2', 'WithoutContext_R2')},
 {R('b.MeanCV_MAE', 'WithContext_MAE')}, {R('b.MeanCV_RMSE', 'WithContext_RMSE')}, {R('b.MeanCV_R2', 'WithContext_R2')}, {R('a.MeanCV_MAE - b.MeanCV_MAE', 'MAE_ImprovementPsi')},
 {R('a.MeanCV_RMSE - b.MeanCV_RMSE', 'RMSE_ImprovementPsi')}, {R('b.MeanCV_R2 - a.MeanCV_R2', 'R2_Improvement')} FROM best a, best b WHERE a.FeatureSet = 'Day0_Context' AND b.FeatureSet = 'Day7_FieldPlusRequired'""")
def _(t):
    return rounded(D.context_impact(best_models(t), _IMPACT))


# Cohort and split decide which predictions an experiment is judged on.
(_A, _B), _C, (_D, _E) = S.R2_STEPS[0][1:], S.R2_STEPS[1][2], S.R2_STEPS[3][1:]
_COMPLETE = ["EffectiveSlump_in", "EffectiveAir_percent", "projectId", *S.RECIPE_CORE]
_EXPERIMENTS = {
    _A: ("Day0_Context", 42, False),
    _B: ("Day0_Context", 42, True),
    _C: ("Day7_FieldPlusRequired", 42, True),
    _D: ("Day0_Context", 7, True),
    _E: ("Day7_FieldPlusRequired", 7, True),
}
_EXP_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS Experiment, * FROM j WHERE FeatureSet = '{f}' AND {bucket(seed)} < 20" + (" AND complete" if c else "") for n, (f, seed, c) in _EXPERIMENTS.items()
)
_STEP_SQL = ", ".join("('" + "', '".join(s) + "')" for s in S.R2_STEPS)


@query("sel06_r2_decomposition", cte("facts", "predictions") + f""", j AS (SELECT p.*, {GROUP_SQL.replace('projectId', 'f.projectId').replace('testId', 'f.testId')} AS SplitGroup, {' AND '.join(f'f.{c} IS NOT NULL' for c in _COMPLETE)} AS complete,
  PredictedStrength28_psi - ActualStrength28_psi AS r FROM predictions p JOIN facts f ON f.testId = p.testId)
, x AS ({_EXP_SQL}), rs AS (SELECT Experiment, Model, count(*) AS RowCount, 1 - sum(r * r) / (var_pop(ActualStrength28_psi) * count(*)) AS R2, avg(abs(r)) AS MAE, stddev_pop(ActualStrength28_psi) AS TargetStd FROM x GROUP BY 1, 2)
SELECT a.Model, s.Effect, s.BeforeVariant, s.AfterVariant, a.RowCount AS Before_RowCount, b.RowCount AS After_RowCount, {R('a.R2', 'Before_R2')}, {R('b.R2', 'After_R2')}, {R('b.R2 - a.R2', 'R2_Change')},
 {R('a.MAE', 'Before_MAE')}, {R('b.MAE', 'After_MAE')}, {R('a.MAE - b.MAE', 'MAE_Improvement')}, {R('a.TargetStd', 'Before_TargetStd')}, {R('b.TargetStd', 'After_TargetStd')}
FROM (VALUES {_STEP_SQL}) s(Effect, BeforeVariant, AfterVariant) JOIN rs a ON a.Experiment = s.BeforeVariant JOIN rs b ON b.Experiment = s.AfterVariant AND b.Model = a.Model""")
def _(t):
    complete = F.lit(True)
    for c in _COMPLETE:
        complete = complete & F.col(c).isNotNull()
    # Buckets are worked out once per test, not once per prediction and experiment.
    seeds = {seed: L.percent_bucket("SplitGroup", seed).alias(f"_bucket{seed}") for _, seed, _ in _EXPERIMENTS.values()}
    flags = grouped(t).select("testId", complete.alias("_complete"), *seeds.values())
    rows = t["predictions"].join(flags, "testId")
    named = [
        F.when((F.col("FeatureSet") == f) & (F.col(f"_bucket{seed}") < 20) & (F.col("_complete") if whole else F.lit(True)), F.lit(n))
        for n, (f, seed, whole) in _EXPERIMENTS.items()
    ]
    rows = rows.withColumn("Experiment", F.explode(F.array_compact(F.array(*named))))
    return rounded(D.r2_decomposition(D.experiment_results(rows, ["Experiment", "Model"])))


# Day-7 predictions exist where there is a day-7 strength; both feature sets are compared on those tests.
@query("sel06_controlled_improvement", cte("facts", "predictions") + f""", c AS (SELECT a.Model, a.Fold, a.ActualStrength28_psi AS y, a.PredictedStrength28_psi - a.ActualStrength28_psi AS ra, b.PredictedStrength28_psi - b.ActualStrength28_psi AS rb
  FROM predictions a JOIN predictions b ON b.testId = a.testId AND b.Model = a.Model JOIN facts f ON f.testId = a.testId AND f.{S.DAY7} IS NOT NULL WHERE a.FeatureSet = 'Day0_Context' AND b.FeatureSet = 'Day7_FieldPlusRequired')
, m AS (SELECT Model, Fold, 1 - sum(ra * ra) / (var_pop(y) * count(*)) AS r2a, 1 - sum(rb * rb) / (var_pop(y) * count(*)) AS r2b, avg(abs(ra)) AS ma, avg(abs(rb)) AS mb FROM c GROUP BY 1, 2)
SELECT Model, 'Day0_Context' AS BeforeVariant, 'Day7_FieldPlusRequired' AS AfterVariant, {R('avg(r2a)', 'Before_Mean_R2')}, {R('avg(r2b)', 'After_Mean_R2')}, {R('avg(r2b) - avg(r2a)', 'Mean_R2_Change')},
 {R('avg(ma)', 'Before_Mean_MAE')}, {R('avg(mb)', 'After_Mean_MAE')}, {R('avg(ma) - avg(mb)', 'Mean_MAE_Improvement')} FROM m GROUP BY 1""")
def _(t):
    known = t["facts"].where(F.col(S.DAY7).isNotNull()).select("testId")
    predictions = t["predictions"]
    day7 = predictions.where("FeatureSet = 'Day7_FieldPlusRequired'").join(known, "testId", "left_semi")
    rows = predictions.where("FeatureSet <> 'Day7_FieldPlusRequired'").unionByName(day7)
    return rounded(D.controlled_improvement(rows, "Day0_Context", "Day7_FieldPlusRequired"))


@query("sel06_experiment_results", PR + f""" SELECT FeatureSet, Model, {REG}, {R('avg(y)', 'TargetMean')}, {R('stddev_pop(y)', 'TargetStd')}, min(y) AS TargetMin, max(y) AS TargetMax,
 {R('quantile_cont(y, 0.01)', 'TargetP01')}, {R('quantile_cont(y, 0.5)', 'TargetP50')}, {R('quantile_cont(y, 0.99)', 'TargetP99')} FROM e GROUP BY 1, 2""")
def _(t):
    return rounded(D.experiment_results(t["predictions"], KEYS))


# ---------------------------------------------------------------- set operations
@query("set01_union_with_missing", cte("facts", "predictions") + """ SELECT testId, Model, CAST(NULL AS DATE) AS castDate FROM predictions UNION ALL SELECT testId, NULL, castDate FROM facts""")
def _(t):
    return t["predictions"].select("testId", "Model").unionByName(t["facts"].select("testId", "castDate"), allowMissingColumns=True)


@query("set02_distinct_keys", cte("facts") + " SELECT DISTINCT SupplierName, plantNumber, mixNumber FROM facts")
def _(t):
    return t["facts"].select("SupplierName", "plantNumber", "mixNumber").distinct()


def unseen_categories(df):
    """Categories of the test side that occur nowhere on the training side."""
    seen = df.where("DatasetSplit = 'train'").select("SupplierPlantMixCategory")
    test = df.where("DatasetSplit = 'test'").select("SupplierPlantMixCategory").distinct()
    return test.join(seen, "SupplierPlantMixCategory", "left_anti")


@query("set04_unseen_categories", cte("facts") + SPLIT + CONTEXT.replace("FROM g)", "FROM sp)") + """
SELECT SupplierPlantMixCategory FROM ctx WHERE DatasetSplit = 'test' EXCEPT SELECT SupplierPlantMixCategory FROM ctx WHERE DatasetSplit = 'train'""")
def _(t):
    df = N.with_context(L.train_test(grouped(t), "SplitGroup"), "SupplierName", "plantNumber", "mixNumber")
    return unseen_categories(df)


@query("joi13_mapping_with_default", cte("facts") + SPLIT + CONTEXT.replace("FROM g)", "FROM sp)") + f""", m AS (SELECT SupplierPlantMixCategory, avg({S.TARGET}) AS v FROM ctx WHERE DatasetSplit = 'train' GROUP BY 1)
SELECT testId, {R(f'coalesce(m.v, (SELECT avg({S.TARGET}) FROM ctx))', 'MappedMean')} FROM ctx LEFT JOIN m USING (SupplierPlantMixCategory)""")
def _(t):
    df = N.with_context(L.train_test(grouped(t), "SplitGroup"), "SupplierName", "plantNumber", "mixNumber")
    mapping = df.where("DatasetSplit = 'train'").groupBy("SupplierPlantMixCategory").agg(F.avg(S.TARGET).alias("v"))
    default = df.agg(F.avg(S.TARGET)).scalar()
    return rounded(df.join(mapping, "SupplierPlantMixCategory", "left").select("testId", F.coalesce("v", default).alias("MappedMean")))
