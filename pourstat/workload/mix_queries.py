"""Queries for mix performance, mix review and recipe candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import clean as C
from pourstat.operators import mixes as X
from pourstat.operators.order_stats import exact_quantiles
from pourstat.workload.clean_queries import RECIPE, _group_sql
from pourstat.workload.profile_queries import union
from pourstat.workload.registry import R, RS, Tables, query, rounded
from pourstat.workload.standins import cte

# Projects of the stand-ins are small; the floors are lowered so groups remain.
MIN_PROJECT, MIN_GROUP = 20, 2
BASE = cte("facts") + RECIPE
ROWS = BASE + f""", er0 AS (SELECT *, row_number() OVER (PARTITION BY testId ORDER BY officeId, projectId, SupplierName, plantNumber, mixNumber, ApplicableSpecifiedStrength28, AverageActualStrength28_psi) AS rn
  FROM recipe WHERE officeId IS NOT NULL AND projectId IS NOT NULL AND SupplierName IS NOT NULL AND plantNumber IS NOT NULL AND mixNumber IS NOT NULL AND ApplicableSpecifiedStrength28 IS NOT NULL)
, er AS (SELECT *, AverageActualStrength28_psi - ApplicableSpecifiedStrength28 AS m, CASE WHEN AverageActualStrength28_psi < ApplicableSpecifiedStrength28 THEN 1 ELSE 0 END AS bad FROM er0 WHERE rn = 1)
, pj AS (SELECT officeId, projectId, count(DISTINCT testId) AS ProjectTestCount, count(DISTINCT SupplierName) AS SupplierCount, count(DISTINCT plantNumber) AS PlantCount, count(DISTINCT mixNumber) AS MixCount,
  avg(AverageActualStrength28_psi) AS AverageActualStrength28_psi, CAST(sum(bad) AS BIGINT) AS FailureCount FROM er GROUP BY 1, 2)
, el AS (SELECT er.* FROM er WHERE EXISTS (SELECT 1 FROM pj WHERE pj.officeId = er.officeId AND pj.projectId = er.projectId AND pj.ProjectTestCount >= {MIN_PROJECT}))"""
_G = "officeId, projectId, SupplierName, plantNumber, mixNumber, ApplicableSpecifiedStrength28"
GROUPS = ROWS + f""", gr AS (SELECT {_G}, count(DISTINCT testId) AS TestCount, avg(AverageActualStrength28_psi) AS AverageActualStrength28_psi, quantile_cont(AverageActualStrength28_psi, 0.5) AS MedianActualStrength28_psi,
  stddev_samp(AverageActualStrength28_psi) AS StrengthStdDev_psi, 100.0::DOUBLE * stddev_samp(AverageActualStrength28_psi) / nullif(avg(AverageActualStrength28_psi), 0) AS StrengthCV_percent,
  CAST(sum(bad) AS BIGINT) AS FailureCount, 100.0::DOUBLE * sum(bad) / count(DISTINCT testId) AS FailureRate_percent, avg(m) AS AverageSpecMargin_psi, quantile_cont(m, 0.5) AS MedianSpecMargin_psi,
  quantile_cont(m, 0.1) AS P10SpecMargin_psi, min(m) AS MinSpecMargin_psi, avg(CalcCementContent_lbs_yd3) AS AverageCementContent_lbs_yd3, avg(FlyAshContent_lbs_yd3) AS AverageFlyAshContent_lbs_yd3,
  avg(TotalCementitiousContent_lbs_yd3) AS AverageTotalCementitious_lbs_yd3, avg(calcWCRatio) AS AverageWCRatio, avg(EffectiveSlump_in) AS AverageSlump_in, count(EffectiveSlump_in) AS SlumpMeasurementCount,
  avg(EffectiveAir_percent) AS AverageAir_percent, count(EffectiveAir_percent) AS AirMeasurementCount FROM el GROUP BY ALL)"""
PEER = GROUPS + f""", pm AS (SELECT *, quantile_cont(AverageTotalCementitious_lbs_yd3, 0.5) OVER (PARTITION BY officeId, projectId, ApplicableSpecifiedStrength28) AS med FROM gr WHERE TestCount >= {MIN_GROUP})
, pe AS (SELECT * EXCLUDE (med), med AS ProjectSpecMedianCementitious_lbs_yd3, 100.0::DOUBLE * (AverageTotalCementitious_lbs_yd3 - med) / nullif(med, 0) AS CementitiousVsProjectMedian_percent FROM pm)"""
_RULE = """CASE WHEN coalesce(FailureRate_percent >= 5, false) OR coalesce(P10SpecMargin_psi < 0, false) THEN 1
  WHEN FailureRate_percent <= 1 AND AverageSpecMargin_psi >= 1200 AND P10SpecMargin_psi > 0 AND StrengthCV_percent <= 15 THEN 2
  WHEN FailureRate_percent <= 1 AND AverageSpecMargin_psi BETWEEN 700 AND 1500 AND P10SpecMargin_psi > 0 AND StrengthCV_percent <= 15
   AND (CementitiousVsProjectMedian_percent IS NULL OR CementitiousVsProjectMedian_percent <= 0) THEN 3 ELSE 4 END"""
FLAGGED = PEER + f""", fl0 AS (SELECT *, {_RULE} AS ReviewPriority FROM pe)
, fl AS (SELECT *, CASE ReviewPriority WHEN 1 THEN '{S.FLAG_RISK}' WHEN 2 THEN '{S.FLAG_OPTIMIZE}' WHEN 3 THEN '{S.FLAG_BENCHMARK}' ELSE '{S.FLAG_MONITOR}' END AS ReviewFlag,
  CASE ReviewPriority WHEN 1 THEN '{S.ACTION_RISK}' WHEN 2 THEN '{S.ACTION_OPTIMIZE}' || CASE WHEN CementitiousVsProjectMedian_percent > 0 THEN '{S.ACTION_ABOVE_MEDIAN}' ELSE '{S.ACTION_BELOW_MEDIAN}' END
   WHEN 3 THEN '{S.ACTION_BENCHMARK}' ELSE '{S.ACTION_MONITOR}' END AS RecommendedAction FROM fl0)
, rk AS (SELECT *, row_number() OVER (PARTITION BY officeId, projectId ORDER BY ReviewPriority, FailureRate_percent DESC, AverageSpecMargin_psi DESC, AverageTotalCementitious_lbs_yd3 DESC NULLS LAST,
  SupplierName, plantNumber, mixNumber, ApplicableSpecifiedStrength28) AS ProjectReviewRank FROM fl)"""


def recipe_rows(t: Tables):
    return C.recipe_cohort(t["facts"])


def eligible(t: Tables):
    rows = X.evaluation_rows(recipe_rows(t))
    return X.eligible_rows(rows, X.project_summary(rows, MIN_PROJECT))


def peers(t: Tables):
    return X.with_peer_median(X.mix_groups(eligible(t)).where(F.col("TestCount") >= MIN_GROUP))


@query("grp36_project_summary", ROWS + f""" SELECT * EXCLUDE (AverageActualStrength28_psi), {R('AverageActualStrength28_psi')}, {R('100.0::DOUBLE * FailureCount / ProjectTestCount', 'FailureRate_percent')},
 ProjectTestCount >= {MIN_PROJECT} AS EligibleProject FROM pj""")
def _(t):
    return rounded(X.project_summary(X.evaluation_rows(recipe_rows(t)), MIN_PROJECT))


@query("joi12_eligible_rows", ROWS + f" SELECT testId, officeId, projectId, {R('m', 'StrengthMargin_psi')} FROM el")
def _(t):
    return rounded(eligible(t).select("testId", "officeId", "projectId", "StrengthMargin_psi"))


_GS = [
    "AverageActualStrength28_psi", "MedianActualStrength28_psi", "StrengthStdDev_psi", "StrengthCV_percent", "FailureRate_percent", "AverageSpecMargin_psi", "MedianSpecMargin_psi",
    "P10SpecMargin_psi", "MinSpecMargin_psi", "AverageCementContent_lbs_yd3", "AverageFlyAshContent_lbs_yd3", "AverageTotalCementitious_lbs_yd3", "AverageWCRatio", "AverageSlump_in", "AverageAir_percent",
]
_GC = ["TestCount", "FailureCount", "SlumpMeasurementCount", "AirMeasurementCount"]


@query("grp37_mix_groups", GROUPS + f" SELECT {_G}, {', '.join(_GC)}, {', '.join(R(c, digits=4) for c in _GS)} FROM gr")
def _(t):
    return rounded(X.mix_groups(eligible(t)), 4)


@query("win03_peer_median", PEER + f" SELECT {_G}, {RS('ProjectSpecMedianCementitious_lbs_yd3', 'CementitiousVsProjectMedian_percent')} FROM pe")
def _(t):
    return rounded(peers(t).select(*X.GROUP, "ProjectSpecMedianCementitious_lbs_yd3", "CementitiousVsProjectMedian_percent"))


@query("prj45_review_flags", FLAGGED + f" SELECT {_G}, ReviewFlag, RecommendedAction, ReviewPriority FROM fl")
def _(t):
    return X.with_review_flag(peers(t)).select(*X.GROUP, "ReviewFlag", "RecommendedAction", "ReviewPriority")


@query("win02_review_rank", FLAGGED + f" SELECT {_G}, ReviewFlag, ProjectReviewRank FROM rk")
def _(t):
    return X.with_review_rank(X.with_review_flag(peers(t))).select(*X.GROUP, "ReviewFlag", "ProjectReviewRank")


_RE = ["AverageActualStrength28_psi", "FailureRate_percent", "AverageSpecMargin_psi", "P10SpecMargin_psi", "AverageTotalCementitious_lbs_yd3", "AverageWCRatio"]


@query("sel09_prj48_historical_evaluation", FLAGGED + f" SELECT {_G}, ReviewFlag, RecommendedAction, ProjectReviewRank, TestCount, {', '.join(f'round_even({c} * 1000, 0) / 1000 AS {c}' for c in _RE)} FROM rk")
def _(t):
    return X.evaluate_history(recipe_rows(t), MIN_PROJECT, MIN_GROUP).select(*X.GROUP, "ReviewFlag", "RecommendedAction", "ProjectReviewRank", "TestCount", *_RE)


OFFICES = [*range(10), *map(str, range(10, 22)), " 22 ", 23]
_CHOSEN = "CAST(officeId AS VARCHAR) IN (" + ", ".join(f"'{str(o).strip()}'" for o in OFFICES) + ")"
_OWN = FLAGGED.replace("FROM recipe WHERE officeId", f"FROM recipe WHERE {_CHOSEN} AND officeId")


@query("sel09_review_candidates", _OWN + f" SELECT {_G}, ReviewFlag, ProjectReviewRank, TestCount, {', '.join(f'round_even({c} * 1000, 0) / 1000 AS {c}' for c in _RE)} FROM rk WHERE ReviewPriority < 4")
def _(t):
    evaluated = X.evaluate_history(recipe_rows(t), MIN_PROJECT, MIN_GROUP, X.HistoryFilters(office=OFFICES))
    return X.review_candidates(evaluated).select(*X.GROUP, "ReviewFlag", "ProjectReviewRank", "TestCount", *_RE)


_STEPS = {
    "input_rows": "(SELECT count(*) FROM recipe)",
    "rows_after_office_filter": f"(SELECT count(*) FROM recipe WHERE {_CHOSEN})",
    "rows_after_project_filter": f"(SELECT count(*) FROM recipe WHERE {_CHOSEN})",
    "rows_after_all_user_filters": f"(SELECT count(*) FROM recipe WHERE {_CHOSEN})",
    "rows_missing_identifier_strength_or_spec": f"(SELECT count(*) FROM recipe WHERE {_CHOSEN} AND (projectId IS NULL OR SupplierName IS NULL OR plantNumber IS NULL OR mixNumber IS NULL OR ApplicableSpecifiedStrength28 IS NULL))",
    "eligible_unique_test_rows": "(SELECT count(*) FROM er)",
    "projects_before_minimum_test_filter": "(SELECT count(*) FROM pj)",
    "projects_meeting_minimum_test_count": f"(SELECT count(*) FROM pj WHERE ProjectTestCount >= {MIN_PROJECT})",
    "rows_in_eligible_projects": "(SELECT count(*) FROM el)",
    "mix_groups_before_minimum_test_filter": "(SELECT count(*) FROM gr)",
    "mix_groups_meeting_minimum_test_count": f"(SELECT count(*) FROM gr WHERE TestCount >= {MIN_GROUP})",
}


@query("sel09_history_audit", _OWN + union(f"SELECT '{n}' AS metric, CAST({q} AS DOUBLE) AS \"value\"" for n, q in _STEPS.items()) + " UNION ALL SELECT 'review_flag: ' || ReviewFlag, CAST(count(*) AS DOUBLE) FROM fl GROUP BY 1")
def _(t):
    return X.history_audit(recipe_rows(t), X.HistoryFilters(office=OFFICES), MIN_PROJECT, MIN_GROUP)


# ---------------------------------------------------------------- mix review
RULE = S.CandidateRule(min_tests=8, min_mean_margin=0.0, min_p05_margin=-3500.0, max_failure_rate=60.0)


def _txt(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN ('', 'nan', 'None', '<NA>') THEN trim({c}) END"


REVIEW = cte("facts") + f""", rv0 AS (SELECT testId, castDate, AverageActualStrength28_psi AS y, AverageActualAgeDays AS age, SpecifiedBreakAge AS ba, ApplicableSpecifiedStrength28 AS RequiredStrength, SpecifiedBreakAgeIs28 AS b28, SpecifiedStrengthMissing AS sm,
  {_txt('SupplierName')} AS SupplierName, {_txt('plantNumber')} AS plantNumber, {_txt('mixNumber')} AS mixNumber FROM facts)
, rv1 AS (SELECT *, {_group_sql('SupplierName')} AS SupplierNameNormalized, {_group_sql('plantNumber')} AS pn, {_group_sql('mixNumber')} AS mixNumberNormalized FROM rv0)
, rv AS (SELECT * REPLACE (coalesce(plantNumber, '<Unknown>') AS plantNumber), coalesce(pn, '<UNKNOWN>') AS plantNumberNormalized FROM rv1 WHERE (b28 = 'True' OR ba = 28) AND sm <> 'True' AND RequiredStrength > 0 AND y > 0
  AND SupplierNameNormalized IS NOT NULL AND mixNumberNormalized IS NOT NULL AND age BETWEEN 25 AND 36
  AND castDate BETWEEN CAST((SELECT max(castDate) FROM facts) - INTERVAL 60 MONTH AS DATE) AND (SELECT max(castDate) FROM facts))
, ts AS (SELECT testId, SupplierNameNormalized, plantNumberNormalized, mixNumberNormalized, RequiredStrength, min(SupplierName) AS SupplierName, min(plantNumber) AS plantNumber, min(mixNumber) AS mixNumber,
  min(castDate) AS castDate, avg(y) AS y, avg(age) AS age, avg(y) - RequiredStrength AS m, CASE WHEN avg(y) < RequiredStrength THEN 1 ELSE 0 END AS bad FROM rv GROUP BY 1, 2, 3, 4, 5)"""
_K = "SupplierNameNormalized, plantNumberNormalized, mixNumberNormalized, RequiredStrength"
MIXES = REVIEW + f""", mx0 AS (SELECT {_K}, min(SupplierName) AS SupplierName, min(plantNumber) AS plantNumber, min(mixNumber) AS mixNumber, count(DISTINCT testId) AS TestCount, avg(y) AS MeanActualStrengthPsi,
  quantile_cont(y, 0.5) AS MedianActualStrengthPsi, avg(m) AS MeanMarginPsi, quantile_cont(m, 0.5) AS MedianMarginPsi, coalesce(stddev_samp(m), 0) AS StdDevMarginPsi, min(m) AS MinimumMarginPsi,
  quantile_cont(m, 0.05) AS P05MarginPsi, quantile_cont(m, 0.95) AS P95MarginPsi, max(m) AS MaximumMarginPsi, CAST(sum(bad) AS BIGINT) AS FailureCount, min(castDate) AS FirstCastDate, max(castDate) AS LastCastDate FROM ts GROUP BY 1, 2, 3, 4)
, mx AS (SELECT *, 100.0::DOUBLE * FailureCount / TestCount AS FailureRatePct, 100 * StdDevMarginPsi / nullif(MeanActualStrengthPsi, 0) AS CoefficientOfVariationPct, MeanMarginPsi - StdDevMarginPsi * 1.645::DOUBLE AS NormalApproxLower5MarginPsi,
  {', '.join(f'''CASE WHEN count(*) OVER (PARTITION BY {p}) <= 1 THEN 100 ELSE (rank() OVER (PARTITION BY {p} ORDER BY MeanMarginPsi) + (count(*) OVER (PARTITION BY {p}, MeanMarginPsi) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {p}) * 100 END AS {n}'''
    for p, n in (('RequiredStrength', 'PeerPercentileWithinRequiredStrength'), ('SupplierNameNormalized, RequiredStrength', 'PeerPercentileWithinSupplierAndRequired')))} FROM mx0)
, st AS (SELECT *, TestCount >= 8 AND MeanMarginPsi >= 0 AND P05MarginPsi >= -3500 AND FailureRatePct <= 60 AS IsReviewCandidate FROM mx)
, sx AS (SELECT *, CASE WHEN IsReviewCandidate THEN '{S.STATUS_CANDIDATE}' WHEN TestCount < 8 THEN '{S.STATUS_FEW}' WHEN FailureRatePct > 60 THEN '{S.STATUS_RISK}' WHEN P05MarginPsi < -3500 THEN '{S.STATUS_TAIL}' ELSE '{S.STATUS_OTHER}' END AS Status FROM st)"""
_MS = [
    "MeanActualStrengthPsi", "MedianActualStrengthPsi", "MeanMarginPsi", "MedianMarginPsi", "StdDevMarginPsi", "MinimumMarginPsi", "P05MarginPsi", "P95MarginPsi", "MaximumMarginPsi", "FailureRatePct",
    "CoefficientOfVariationPct", "NormalApproxLower5MarginPsi",
]


def review(t: Tables):
    source = t["facts"].withColumn("RequiredStrength", F.col(S.REQUIRED))
    rows = X.review_rows(source, lookback_months=60, age_days=(25, 36))
    return source, rows, X.collapse_tests(rows)


@query("flt16_review_rows", REVIEW + " SELECT testId, SupplierName, plantNumber, mixNumber, SupplierNameNormalized, plantNumberNormalized, mixNumberNormalized, RequiredStrength FROM rv")
def _(t):
    return review(t)[1].select("testId", "SupplierName", "plantNumber", "mixNumber", *X.REVIEW_KEYS)


@query("grp32_collapsed_tests", REVIEW + f" SELECT testId, {_K}, SupplierName, castDate, {R('y', S.TARGET)}, {R('age', 'AverageActualAgeDays')}, {R('m', 'StrengthMargin_psi')}, bad AS IsBelowRequired FROM ts")
def _(t):
    return rounded(review(t)[2].select("testId", *X.REVIEW_KEYS, "SupplierName", "castDate", S.TARGET, "AverageActualAgeDays", "StrengthMargin_psi", "IsBelowRequired"))


@query("grp33_mix_summary", MIXES + f" SELECT {_K}, TestCount, FailureCount, FirstCastDate, LastCastDate, {', '.join(R(c, digits=4) for c in _MS)} FROM sx")
def _(t):
    return rounded(X.summarize_mixes(review(t)[2], RULE).select(*X.REVIEW_KEYS, "TestCount", "FailureCount", "FirstCastDate", "LastCastDate", *_MS), 4)


@query("win01_peer_percentiles", MIXES + f" SELECT {_K}, {RS('PeerPercentileWithinRequiredStrength', 'PeerPercentileWithinSupplierAndRequired')} FROM sx")
def _(t):
    return rounded(X.summarize_mixes(review(t)[2], RULE).select(*X.REVIEW_KEYS, "PeerPercentileWithinRequiredStrength", "PeerPercentileWithinSupplierAndRequired"))


@query("prj46_mix_status", MIXES + f" SELECT {_K}, IsReviewCandidate, Status FROM sx")
def _(t):
    return X.summarize_mixes(review(t)[2], RULE).select(*X.REVIEW_KEYS, "IsReviewCandidate", "Status")


def _n0(c: str) -> str:
    return f"format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT))"


@query("sel10_prj47_mix_review_report", MIXES + f""", rp AS (SELECT * REPLACE ({', '.join(f'round_even({c} * 100, 0) / 100 AS {c}' for c in ('MeanMarginPsi', 'P05MarginPsi', 'FailureRatePct'))}) FROM sx)
SELECT {_K}, SupplierName || ' | Plant ' || plantNumber || ' | Mix ' || mixNumber || ' | Req ' || {_n0('RequiredStrength')} AS GroupLabel, Status, MeanMarginPsi, FailureRatePct,
 CASE WHEN IsReviewCandidate THEN 'Over the past 60 months, ' || SupplierName || ' Plant ' || plantNumber || ' Mix ' || mixNumber || ' averaged ' || {_n0('MeanMarginPsi')} || ' psi above its ' || {_n0('RequiredStrength')} ||
  '-psi required 28-day strength across ' || TestCount || ' valid tests. The lower 5th-percentile margin was ' || {_n0('P05MarginPsi')} || ' psi, with ' ||
  CASE WHEN FailureCount = 0 THEN 'no below-required results' ELSE FailureCount || ' below-required result(s), a ' || format('{{:.1f}}', round_even(FailureRatePct * 10, 0) / 10) || '% rate' END ||
  '. This mix may be a candidate for engineering mix-design review.' END AS Message FROM rp""")
def _(t):
    report = X.review_report(X.summarize_mixes(review(t)[2], RULE), 60)
    return report.select(*X.REVIEW_KEYS, "GroupLabel", "Status", "MeanMarginPsi", "FailureRatePct", "Message")


@query("grp35_review_quality", REVIEW + union([
    "SELECT 'OriginalRows' AS Metric, count(*) AS Value FROM facts", "SELECT 'RowsAfterFiltering', count(*) FROM rv", "SELECT 'UniqueTestsAfterDeduplication', count(DISTINCT testId) FROM ts",
    "SELECT 'DuplicateRowsCollapsed', (SELECT count(*) FROM rv) - count(*) FROM ts", f"SELECT 'DistinctMixGroups', count(*) FROM (SELECT DISTINCT {_K} FROM ts)"]))
def _(t):
    return X.review_quality(*review(t))


@query("win05_margin_trend", MIXES + f""" SELECT testId, ts.castDate, {R('avg(m) OVER (PARTITION BY SupplierNameNormalized, plantNumberNormalized, mixNumberNormalized, RequiredStrength ORDER BY ts.castDate, testId ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 'RollingMeanMarginPsi')}
FROM ts WHERE EXISTS (SELECT 1 FROM sx WHERE sx.IsReviewCandidate AND {' AND '.join(f'sx.{c} = ts.{c}' for c in _K.split(', '))})""")
def _(t):
    tests = review(t)[2]
    candidates = X.summarize_mixes(tests, RULE).where("IsReviewCandidate")
    return rounded(X.margin_trend(tests, candidates).select("testId", "castDate", "RollingMeanMarginPsi"))


# ---------------------------------------------------------------- recipe candidates
_RECIPE = ["CalcCementContent_lbs_yd3", "FlyAshContent_lbs_yd3", "calcWCRatio", "SandSSD_lbs_yd3", "AggregateSSD_lbs_yd3"]


@query("sel08_recipe_candidates", BASE + f""", pr AS (SELECT *, AverageActualStrength28_psi * 0.9::DOUBLE + CalcCementContent_lbs_yd3 AS pred, EffectiveSlump_in AS slump FROM recipe), q AS (SELECT quantile_cont(abs(pred - AverageActualStrength28_psi), 0.9) AS p90 FROM pr)
, ds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_RECIPE)} ORDER BY testId) AS rn FROM pr) WHERE rn = 1)
SELECT testId, CalcCementContent_lbs_yd3, {R('pred', 'PredictedStrength28_psi')}, {R('pred - p90', 'ConservativeStrength28_psi')} FROM ds, q WHERE pred - p90 >= 4250 AND slump >= 3 AND slump <= 8
ORDER BY CalcCementContent_lbs_yd3, pred - p90 DESC, testId LIMIT 25""")
def _(t):
    rows = recipe_rows(t).withColumns(
        {
            "PredictedStrength28_psi": F.col(S.TARGET) * F.lit(0.9) + F.col("CalcCementContent_lbs_yd3"),
            "PredictedSlump_in": F.col("EffectiveSlump_in"),
        }
    )
    errors = rows.select(F.abs(F.col("PredictedStrength28_psi") - F.col(S.TARGET)).alias("e"))
    p90 = exact_quantiles(errors, [], "e", {"p90": 0.9}).scalar()
    out = X.recipe_candidates(rows, _RECIPE, p90, 4000.0, 250.0, slump=(3.0, 8.0))
    return rounded(out.select("testId", "CalcCementContent_lbs_yd3", "PredictedStrength28_psi", "ConservativeStrength28_psi"))
