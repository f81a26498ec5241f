"""Queries for cleaning, cohorts, derived features and specimen preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import clean as C
from pourstat.operators import profile as P
from pourstat.workload.registry import R, RS, Tables, query, rounded
from pourstat.workload.standins import cte

FIRST, LAST = "1995-06-01", "2001-03-31"


def num(c: str) -> str:
    x = f"try_cast(replace(trim({c}), ',', '') AS DOUBLE)"
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


def pe(a: str, b: str, digits: int = 2) -> str:
    k = 10**digits
    return f"round_even(100.0::DOUBLE * ({a}) / nullif({b}, 0) * {k}, 0) / {k}"


EXPORT_TEXT = [
    "testId", "projectId", "ConcreteTestUnitSystem", "castDate", "AverageActualStrength28_psi", "ApplicableSpecifiedStrength28",
    "EffectiveSlump_in", "EffectiveAir_percent", "EffectiveUnitWeight_lb_ft3", "EffectiveConcreteTemp_F", "AmbientTemp_F",
    "HasWaterAdded", "SupplierName", "plantNumber", "mixNumber",
]


@query("prj13_blank_text", cte("export_rows") + " SELECT " + ", ".join(
    f"CASE WHEN trim({c}) NOT IN ('', 'NULL', 'null', 'Null') THEN trim({c}) END AS {c}" for c in EXPORT_TEXT) + " FROM export_rows")
def _(t: Tables):
    return C.blanks_to_null(t["export_rows"])


@query("prj20_22_parsing", cte("export_rows") + f"""
SELECT testId, {num('AverageActualStrength28_psi')} AS strength, {num('ApplicableSpecifiedStrength28')} AS required, {num('EffectiveSlump_in')} AS slump,
 CASE WHEN try_cast(lower(trim(HasWaterAdded)) AS DOUBLE) IN (0, 1) THEN CAST(try_cast(lower(trim(HasWaterAdded)) AS DOUBLE) AS INT)
      WHEN lower(trim(HasWaterAdded)) IN ('true','yes','y') THEN 1 WHEN lower(trim(HasWaterAdded)) IN ('false','no','n') THEN 0 END AS flag_or_null,
 coalesce(lower(trim(HasWaterAdded)) IN ('true','1','yes','y','t'), false) AS flag_or_false,
 try_cast(castDate AS DATE) AS cast_day, CAST(year(try_cast(castDate AS DATE)) AS INT) AS cast_year FROM export_rows""")
def _(t):
    return t["export_rows"].select(
        "testId",
        E.number("AverageActualStrength28_psi").alias("strength"),
        E.number("ApplicableSpecifiedStrength28").alias("required"),
        E.number("EffectiveSlump_in").alias("slump"),
        E.flag_value("HasWaterAdded").alias("flag_or_null"),
        E.truthy("HasWaterAdded").alias("flag_or_false"),
        E.day("castDate").alias("cast_day"),
        F.year(E.day("castDate")).alias("cast_year"),
    )


_RANGED = {k: v for k, v in S.MODEL_RANGES.items() if k != "EffectiveSpread_in"}


@query("prj23_ranges_to_null", cte("facts") + " SELECT testId, " + ", ".join(
    f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, (lo, hi) in _RANGED.items()) + " FROM facts")
def _(t):
    return C.null_outside(t["facts"], S.MODEL_RANGES).select("testId", *_RANGED)


@query("grp25_range_audit", cte("facts") + " UNION ALL ".join(
    f" SELECT '{c}' AS \"Column\", 1 AS PresentInInput, CAST({lo} AS DOUBLE) AS MinimumAllowed, CAST({hi} AS DOUBLE) AS MaximumAllowed, "
    f"count(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 END) AS ValuesSetToMissing FROM facts" for c, (lo, hi) in S.CLEAN_RANGES.items()))
def _(t):
    return C.range_audit(t["facts"], S.CLEAN_RANGES)


# ---------------------------------------------------------------- field-core cleaning
_CF = ["EffectiveSlump_in", "EffectiveAir_percent", "EffectiveUnitWeight_lb_ft3", "EffectiveConcreteTemp_F", "AmbientTemp_F"]
_CR = {c: S.CLEAN_RANGES[c] for c in _CF}
CLEANED = f""", e0 AS (SELECT testId, {num('AverageActualStrength28_psi')} AS y, {num('ApplicableSpecifiedStrength28')} AS r, {num('ConcreteTestUnitSystem')} AS u,
   try_cast(castDate AS DATE) AS d, {num('HasWaterAdded')} AS w, {', '.join(num(c) + ' AS ' + c for c in _CF)}, count(*) OVER (PARTITION BY testId) AS n FROM export_rows)
, e1 AS (SELECT testId, y, u, d, n, CASE WHEN r > 0 AND r <= 20000 THEN r END AS r,
   {', '.join(f'CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}' for c, (lo, hi) in _CR.items())},
   {', '.join(f'CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 ELSE 0 END AS {c}_OutOfRange' for c, (lo, hi) in _CR.items())},
   CASE WHEN w IN (0, 1) THEN w END AS HasWaterAdded, CASE WHEN w IS NOT NULL AND w NOT IN (0, 1) THEN 1 ELSE 0 END AS HasWaterAdded_InvalidIndicator,
   CASE WHEN y > 0 AND y < 1000 THEN 1 ELSE 0 END AS TargetBelow1000Psi_Review, CASE WHEN r <= 0 OR r > 20000 THEN 1 ELSE 0 END AS RequiredStrengthInvalid,
   CASE WHEN r > 0 AND r < 1000 THEN 1 ELSE 0 END AS RequiredStrengthBelow1000Psi_Review FROM e0)
, cleaned AS (SELECT testId, y AS AverageActualStrength28_psi, r AS ApplicableSpecifiedStrength28, d AS castDate, HasWaterAdded, {', '.join(_CF)},
   {' + '.join(c + '_OutOfRange' for c in _CF)} + HasWaterAdded_InvalidIndicator + TargetBelow1000Psi_Review + RequiredStrengthInvalid
     + RequiredStrengthBelow1000Psi_Review AS CleaningReviewFlagCount, TargetBelow1000Psi_Review, HasWaterAdded_InvalidIndicator,
   nullif(concat_ws(';', CASE WHEN n > 1 THEN 'DuplicateTestId' END, CASE WHEN u IS NULL OR u <> 0 THEN 'NonUSUnitSystem' END,
     CASE WHEN d IS NULL OR d < DATE '{FIRST}' OR d > DATE '{LAST}' THEN 'InvalidCastDate' END,
     CASE WHEN y IS NULL OR y <= 0 OR y > 20000 THEN 'Invalid28DayTarget' END,
     CASE WHEN coalesce(EffectiveSlump_in, EffectiveAir_percent, EffectiveUnitWeight_lb_ft3, EffectiveConcreteTemp_F) IS NULL THEN 'NoUsableCoreFreshMeasurement' END), '')
     AS CleaningExclusionReasons FROM e1)"""
_CLEAN_OUT = [
    "testId", S.TARGET, S.REQUIRED, "castDate", "HasWaterAdded", *_CF, "CleaningReviewFlagCount", "TargetBelow1000Psi_Review",
    "HasWaterAdded_InvalidIndicator", "CleaningExclusionReasons",
]


def cleaned(t: Tables):
    return C.clean_export(t["export_rows"], FIRST, LAST)


@query("prj24_26_cleaning_reasons_and_flags", cte("export_rows") + CLEANED + f" SELECT {', '.join(_CLEAN_OUT)} FROM cleaned")
def _(t):
    return cleaned(t).select(*_CLEAN_OUT)


@query("flt05_cleaning_cohorts", cte("export_rows") + CLEANED + """
SELECT 'clean_base' AS cohort, testId FROM cleaned WHERE CleaningExclusionReasons IS NULL
UNION ALL SELECT 'clean_with_required', testId FROM cleaned WHERE CleaningExclusionReasons IS NULL AND ApplicableSpecifiedStrength28 IS NOT NULL
UNION ALL SELECT 'excluded', testId FROM cleaned WHERE CleaningExclusionReasons IS NOT NULL
UNION ALL SELECT 'review', testId FROM cleaned WHERE CleaningReviewFlagCount > 0""")
def _(t):
    parts = [df.select(F.lit(n).alias("cohort"), "testId") for n, df in C.clean_cohorts(cleaned(t)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("snk04_cleaning_run_summary", cte("export_rows") + CLEANED + """
SELECT count(*) AS input_records, count(DISTINCT testId) AS unique_tests, count(CASE WHEN CleaningExclusionReasons IS NULL THEN 1 END) AS clean_base_records,
 count(CASE WHEN CleaningExclusionReasons IS NULL AND ApplicableSpecifiedStrength28 IS NOT NULL THEN 1 END) AS clean_with_required_records,
 count(CleaningExclusionReasons) AS excluded_records, count(CASE WHEN CleaningReviewFlagCount > 0 THEN 1 END) AS records_with_review_flags FROM cleaned""")
def _(t):
    return C.cleaning_summary(cleaned(t))


EXTERNAL = """, x AS (SELECT *, CAST(year(castDate) AS INT) AS ExternalValidationYear, nullif(concat_ws(';',
   CASE WHEN castDate IS NULL OR year(castDate) NOT BETWEEN 1999 AND 2001 THEN 'OutsideExternalYearRange' END,
   CASE WHEN ConcreteTestUnitSystem <> 0 THEN 'NonUSUnitSystem' END,
   CASE WHEN AverageActualStrength28_psi IS NULL OR AverageActualStrength28_psi <= 0 OR AverageActualStrength28_psi > 20000 THEN 'InvalidActualStrength28' END,
   CASE WHEN ApplicableSpecifiedStrength28 IS NULL OR ApplicableSpecifiedStrength28 <= 0 OR ApplicableSpecifiedStrength28 > 20000 THEN 'InvalidRequiredStrength28' END,
   CASE WHEN count(*) OVER (PARTITION BY testId) > 1 THEN 'DuplicateTestId' END), '') AS ExternalExclusionReasons FROM facts)"""


@query("prj26_external_reasons", cte("facts") + EXTERNAL + " SELECT testId, ExternalValidationYear, ExternalExclusionReasons FROM x")
def _(t):
    return C.external_reasons(t["facts"], 1999, 2001).select("testId", "ExternalValidationYear", "ExternalExclusionReasons")


@query("grp30_year_summary", cte("facts") + EXTERNAL + f"""
SELECT ExternalValidationYear, count(*) AS RowCount, count(DISTINCT testId) AS UniqueTests, {R('avg(AverageActualStrength28_psi)', 'ActualStrength28Mean')},
 {R('avg(ApplicableSpecifiedStrength28)', 'RequiredStrength28Mean')} FROM x WHERE ExternalExclusionReasons IS NULL GROUP BY 1""")
def _(t):
    return rounded(C.year_summary(C.external_reasons(t["facts"], 1999, 2001)))


# ---------------------------------------------------------------- candidates
_FRESH = "coalesce(EffectiveSlump_in, EffectiveSpread_in, EffectiveAir_percent, EffectiveUnitWeight_lb_ft3, EffectiveConcreteTemp_F)"
MARKED = f""", m0 AS (SELECT *, count(*) OVER (PARTITION BY testId) AS n, coalesce(ConcreteTestUnitSystem = 0, false) AS u,
   coalesce(castDate BETWEEN DATE '{FIRST}' AND DATE '{LAST}', false) AS d, coalesce(AverageActualStrength28_psi > 0, false) AS y,
   coalesce(ApplicableSpecifiedStrength28 > 0, false) AS r, {_FRESH} IS NOT NULL AS f FROM facts)
, m1 AS (SELECT *, n = 1 AND u AND d AND y AND f AS ok, {' AND '.join(c + ' IS NOT NULL' for c in S.FIELD_FEATURES)} AS complete FROM m0)
, marked AS (SELECT * EXCLUDE (n, u, d, y, r, f, ok, complete), CASE WHEN n > 1 THEN 1 ELSE 0 END AS DuplicateTestId,
   {' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in S.FRESH_COLUMNS)} AS AvailableFreshMeasurementCount,
   CAST(u AS INT) AS ValidUSUnitSystem, CAST(d AS INT) AS ValidCastDateForModel, CAST(ok AS INT) AS FieldCoreBaseEligible, CAST(ok AND r AS INT) AS FieldCoreWithRequiredEligible,
   CAST(ok AND complete AS INT) AS FieldCoreCompleteCase,
   nullif(concat_ws(';', CASE WHEN n > 1 THEN 'DuplicateTestId' END, CASE WHEN NOT u THEN 'NonUSUnitSystem' END, CASE WHEN NOT d THEN 'InvalidOrMissingCastDate' END,
    CASE WHEN NOT y THEN 'MissingOrNonPositiveStandardCured28Strength' END, CASE WHEN NOT f THEN 'NoEffectiveFreshMeasurement' END), '') AS BaseExclusionReasons FROM m1)"""
_MARK_OUT = [
    "testId", "DuplicateTestId", "AvailableFreshMeasurementCount", "ValidUSUnitSystem", "ValidCastDateForModel", "FieldCoreBaseEligible",
    "FieldCoreWithRequiredEligible", "FieldCoreCompleteCase", "BaseExclusionReasons",
]


@query("flt06_07_model_candidates", cte("facts") + MARKED + f" SELECT {', '.join(_MARK_OUT)} FROM marked")
def _(t):
    return C.mark_candidates(t["facts"], FIRST, LAST).select(*_MARK_OUT)


_COMPLETE = ["EffectiveSlump_in", "EffectiveAir_percent"]


@query("flt06_complete_cases", cte("facts") + """
SELECT testId FROM facts WHERE EffectiveSlump_in IS NOT NULL AND EffectiveAir_percent IS NOT NULL""")
def _(t):
    return C.complete_rows(t["facts"], _COMPLETE).select("testId")


@query("flt07_any_present", cte("facts") + " SELECT testId FROM facts WHERE EffectiveSlump_in IS NOT NULL OR EffectiveAir_percent IS NOT NULL")
def _(t):
    return C.any_present(t["facts"], _COMPLETE).select("testId")


@query("flt08_mix_model_rows", cte("facts") + """
SELECT testId, calcWCRatio FROM facts WHERE AverageActualStrength28_psi > 0 AND AverageActualAgeDays BETWEEN 25 AND 35 AND CalcCementContent_lbs_yd3 > 0
 AND SandSSD_lbs_yd3 > 0 AND AggregateSSD_lbs_yd3 > 0 AND calcWCRatio BETWEEN 0.20::DOUBLE AND 0.90::DOUBLE AND FlyAshContent_lbs_yd3 IS NOT NULL
 AND SandMoisture_percent IS NOT NULL AND AggregateMoisture_percent IS NOT NULL""")
def _(t):
    return C.mix_model_rows(t["facts"]).select("testId", "calcWCRatio")


@query("flt09_working_rows", cte("facts") + """
SELECT testId FROM facts WHERE SpecifiedStrengthMissing <> 'True' AND testSubTypeId = 30050 AND CalcCementContent_lbs_yd3 <> 0 AND AggregateSSD_lbs_yd3 <> 0
 AND SandSSD_lbs_yd3 <> 0 AND AverageActualAgeDays <> 0 AND calcWCRatio <> 0 AND SandMoisture_percent IS NOT NULL AND FlyAshContent_lbs_yd3 IS NOT NULL""")
def _(t):
    return C.working_rows(t["facts"]).select("testId")


@query("flt10_valid_day7_prj36", cte("facts") + f"""
SELECT testId, AverageActualStrength7_psi AS Day7AverageStrength_psi, CAST(ActualStrength7SpecimenCount AS DOUBLE) AS Day7SpecimenCount,
 AverageActualStrength7_psi - ApplicableSpecifiedStrength28 AS Day7MarginToRequired_psi,
 {R('AverageActualStrength7_psi / nullif(ApplicableSpecifiedStrength28, 0)', 'Day7ToRequiredRatio')},
 {R('CASE WHEN ApplicableSpecifiedStrength28 > 0 THEN AverageActualStrength7_psi / ApplicableSpecifiedStrength28 END', 'Strength7ToSpecifiedStrength28Ratio')},
 AverageActualStrength7_psi - ApplicableSpecifiedStrength28 AS Strength7Margin_psi FROM facts WHERE AverageActualStrength7_psi > 0""")
def _(t):
    df = C.with_day7_compliance(C.valid_day7(C.with_day7(t["facts"])))
    return rounded(df.select("testId", *S.DAY7_FEATURES, "Strength7ToSpecifiedStrength28Ratio", "Strength7Margin_psi"))


@query("flt11_filter_trail", cte("facts") + """
SELECT count(*) AS input_rows, count(CASE WHEN ConcreteTestUnitSystem = 0 THEN 1 END) AS after_unit_system_filter,
 count(CASE WHEN ConcreteTestUnitSystem = 0 AND IsValidCastDate = 1 THEN 1 END) AS after_valid_date_filter FROM facts""")
def _(t):
    return C.filter_trail(
        t["facts"],
        [
            ("after_unit_system_filter", F.col("ConcreteTestUnitSystem") == 0),
            ("after_valid_date_filter", F.col("IsValidCastDate") == 1),
        ],
    )


# ---------------------------------------------------------------- suspicious values
SUSPECT = f""", q AS (SELECT quantile_cont(AverageActualStrength28_psi, 0.25) AS q1, quantile_cont(AverageActualStrength28_psi, 0.75) AS q3, count(AverageActualStrength28_psi) AS n FROM facts)
, s0 AS (SELECT testId, {', '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END AS {n}' for n, c in zip(C.SUSPICIOUS_FLAGS, [
    'AverageActualStrength28_psi <= 0', 'ApplicableSpecifiedStrength28 <= 0', 'EffectiveSlump_in < 0', 'EffectiveSpread_in < 0', 'EffectiveAir_percent < 0',
    'EffectiveUnitWeight_lb_ft3 <= 0', 'WaterAdded_gal_per_yd3 < 0', 'LoadBatchVolumeRaw <= 0', 'BatchToSampleMinutes > 1440', 'BatchToCastMinutes > 1440',
    'n >= 8 AND (AverageActualStrength28_psi < q1 - 3 * (q3 - q1) OR AverageActualStrength28_psi > q3 + 3 * (q3 - q1))']))} FROM facts, q)
, suspect AS (SELECT *, {' + '.join(C.SUSPICIOUS_FLAGS)} AS SuspiciousValueFlagCount FROM s0)"""


@query("prj28_suspicious_values", cte("facts") + SUSPECT + " SELECT *, CASE WHEN SuspiciousValueFlagCount > 0 THEN 1 ELSE 0 END AS HasSuspiciousValue FROM suspect")
def _(t):
    return C.suspicious_flags(t["facts"]).select("testId", *C.SUSPICIOUS_FLAGS, "SuspiciousValueFlagCount", "HasSuspiciousValue")


@query("grp27_suspicious_summary", cte("facts") + SUSPECT + " UNION ALL ".join(
    f" SELECT '{c}' AS ReviewFlag, CAST(sum({c}) AS BIGINT) AS RowCount, {pe(f'sum({c})', 'count(*)')} AS Percent FROM suspect" for c in C.SUSPICIOUS_FLAGS))
def _(t):
    return P.flag_summary(C.suspicious_flags(t["facts"]), C.SUSPICIOUS_FLAGS)


_RF = ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN 0 ELSE 1 END AS {n}" for n, (c, lo, hi) in C.RECIPE_REVIEW.items())


@query("prj29_suspicious_recipes", cte("facts") + f""", s AS (SELECT testId, {_RF} FROM facts) SELECT * FROM s WHERE greatest({', '.join(C.RECIPE_REVIEW)}) = 1""")
def _(t):
    return C.suspicious_recipes(t["facts"]).select("testId", *C.RECIPE_REVIEW)


# ---------------------------------------------------------------- text
_CAT = r"coalesce(nullif(regexp_replace(upper(trim({c})), '\s+', ' ', 'g'), ''), '__MISSING__')"
_GV = r"regexp_replace(upper(trim({c})), '\s+', '', 'g')"


def _group_sql(c: str) -> str:
    g = _GV.format(c=c)
    return (
        f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'none', '<na>') THEN NULL WHEN regexp_matches({g}, '^[0-9]+$') "
        f"THEN coalesce(nullif(ltrim({g}, '0'), ''), '0') ELSE {g} END"
    )


@query("prj30_35_keys_and_categories", cte("export_rows") + f"""
SELECT testId, {_CAT.format(c='SupplierName')} AS SupplierCategory, {_group_sql('SupplierName')} AS SupplierNormalized, {_group_sql('plantNumber')} AS PlantNormalized,
 {_group_sql('mixNumber')} AS MixNormalized, {_CAT.format(c='SupplierName')} || '|' || {_CAT.format(c='plantNumber')} AS SupplierPlantCategory,
 {_CAT.format(c='SupplierName')} || '|' || {_CAT.format(c='plantNumber')} || '|' || {_CAT.format(c='mixNumber')} AS SupplierPlantMixCategory,
 coalesce(nullif(trim(projectId), ''), 'MISSING_PROJECT_TEST_' || testId) AS SplitGroup,
 coalesce(SupplierName, 'UNKNOWN') || '|' || coalesce(plantNumber, 'UNKNOWN') || '|' || coalesce(mixNumber, 'UNKNOWN') AS MixGroup FROM export_rows""")
def _(t):
    supplier, plant, mix = (E.category(c) for c in ("SupplierName", "plantNumber", "mixNumber"))
    return t["export_rows"].select(
        "testId",
        supplier.alias("SupplierCategory"),
        E.group_value("SupplierName").alias("SupplierNormalized"),
        E.group_value("plantNumber").alias("PlantNormalized"),
        E.group_value("mixNumber").alias("MixNormalized"),
        E.joined_key([supplier, plant]).alias("SupplierPlantCategory"),
        E.joined_key([supplier, plant, mix]).alias("SupplierPlantMixCategory"),
        E.project_group("projectId", "testId").alias("SplitGroup"),
        E.joined_key([F.col("SupplierName"), F.col("plantNumber"), F.col("mixNumber")], "UNKNOWN").alias("MixGroup"),
    )


CURING = r"nullif(regexp_replace(regexp_replace(lower(trim(InitialCuringConditionRaw)), '\s+', ' ', 'g'), '[^a-z0-9%+./ -]', '', 'g'), '')"


@query("prj32_curing_text", cte("facts") + f" SELECT testId, {CURING} AS text FROM facts")
def _(t):
    return t["facts"].select("testId", E.curing_text("InitialCuringConditionRaw").alias("text"))


# ---------------------------------------------------------------- derived features
_DEV = {
    "SlumpBelowMinAmount": "greatest(uwSlump_specMin - EffectiveSlump_in, 0)",
    "SlumpAboveMaxAmount": "greatest(EffectiveSlump_in - uwSlump_specMax, 0)",
    "AirBelowMinAmount": "greatest(uwAir_specMin - EffectiveAir_percent, 0)",
    "AirAboveMaxAmount": "greatest(EffectiveAir_percent - uwAir_specMax, 0)",
}


def _dev(n: str) -> str:
    m, v = ("Slump", "EffectiveSlump_in") if n.startswith("Slump") else ("Air", "EffectiveAir_percent")
    side = "specMin" if "Below" in n else "specMax"
    return f"CASE WHEN uw{m}_{side} IS NOT NULL AND {v} IS NOT NULL THEN {_DEV[n]} END"


@query("prj37_deviations", cte("facts") + f"""
SELECT testId, {', '.join(R(_dev(n), n) for n in _DEV)}, CASE WHEN SlumpOutOfSpecFlag IS NULL AND AirOutOfSpecFlag IS NULL THEN NULL
 ELSE CAST(coalesce(SlumpOutOfSpecFlag, 0) + coalesce(AirOutOfSpecFlag, 0) AS DOUBLE) END AS FieldOutOfSpecCount FROM facts""")
def _(t):
    return rounded(C.with_deviations(t["facts"]).select("testId", *_DEV, "FieldOutOfSpecCount"))


@query("prj38_failure_mismatch", cte("facts") + """
SELECT testId, CASE WHEN AverageActualStrength28_psi IS NULL OR ApplicableSpecifiedStrength28 IS NULL THEN NULL
  WHEN AverageActualStrength28_psi < ApplicableSpecifiedStrength28 THEN 1 ELSE 0 END AS FailureFlag28,
 CASE WHEN AverageActualStrength28_psi IS NOT NULL AND ApplicableSpecifiedStrength28 IS NOT NULL
   AND FailureFlag28 <> CAST(AverageActualStrength28_psi < ApplicableSpecifiedStrength28 AS INT) THEN 1 ELSE 0 END AS FailureFlagMismatch FROM facts""")
def _(t):
    return C.with_recomputed_failure(t["facts"]).select("testId", S.FAILURE, "FailureFlagMismatch")


_RC = {c: r for c, r in S.RECIPE_RANGES.items() if c in ("CalcCementContent_lbs_yd3", "calcWCRatio", "SandSSD_lbs_yd3", "AggregateSSD_lbs_yd3", S.TARGET)}
RECIPE = f""", r0 AS (SELECT *, CASE WHEN CalcCementContent_lbs_yd3 IS NOT NULL AND FlyAshContent_lbs_yd3 IS NULL THEN 0 ELSE FlyAshContent_lbs_yd3 END AS ash,
   CASE WHEN CalcCementContent_lbs_yd3 IS NOT NULL AND FlyAshContent_lbs_yd3 IS NULL THEN 1 ELSE 0 END AS assumed FROM facts WHERE ConcreteTestUnitSystem = 0 AND IsValidCastDate = 1)
, r1 AS (SELECT testId, assumed, projectId, officeId, SupplierName, plantNumber, mixNumber, CASE WHEN ApplicableSpecifiedStrength28 BETWEEN 500 AND 20000 THEN ApplicableSpecifiedStrength28 END AS ApplicableSpecifiedStrength28,
   {', '.join(f'CASE WHEN {c} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN {c} END AS {c}' for c, (lo, hi) in _RC.items())}, CASE WHEN ash BETWEEN 0 AND 800 THEN ash END AS FlyAshContent_lbs_yd3,
   CASE WHEN EffectiveSlump_in BETWEEN 0 AND 20 THEN EffectiveSlump_in END AS EffectiveSlump_in, CASE WHEN EffectiveAir_percent BETWEEN 0 AND 20 THEN EffectiveAir_percent END AS EffectiveAir_percent FROM r0)
, recipe AS (SELECT *, CalcCementContent_lbs_yd3 + FlyAshContent_lbs_yd3 AS TotalCementitiousContent_lbs_yd3, FlyAshContent_lbs_yd3 / nullif(CalcCementContent_lbs_yd3 + FlyAshContent_lbs_yd3, 0) AS FlyAshFraction,
   SandSSD_lbs_yd3 + AggregateSSD_lbs_yd3 AS TotalAggregateSSD_lbs_yd3, SandSSD_lbs_yd3 / nullif(SandSSD_lbs_yd3 + AggregateSSD_lbs_yd3, 0) AS SandFractionOfAggregate FROM r1
  WHERE CalcCementContent_lbs_yd3 IS NOT NULL AND FlyAshContent_lbs_yd3 IS NOT NULL AND calcWCRatio IS NOT NULL AND SandSSD_lbs_yd3 IS NOT NULL
   AND AggregateSSD_lbs_yd3 IS NOT NULL AND AverageActualStrength28_psi IS NOT NULL)"""
_RECIPE_OUT = [*S.RECIPE_CORE, *S.RECIPE_DERIVED, S.TARGET]


@query("prj39_40_recipe_cohort", cte("facts") + RECIPE + f" SELECT testId, {RS(*_RECIPE_OUT)} FROM recipe")
def _(t):
    return rounded(C.recipe_cohort(t["facts"]).select("testId", *_RECIPE_OUT))


@query("grp46_recipe_summary", cte("facts") + RECIPE + f"""
SELECT count(*) AS batch_complete_strength_rows, count(DISTINCT projectId) AS projects, count(DISTINCT SupplierName) AS suppliers, count(DISTINCT plantNumber) AS plants,
 count(DISTINCT mixNumber) AS mixes, CAST(sum(assumed) AS BIGINT) AS fly_ash_assumed_zero_rows, (SELECT count(*) FROM facts) AS input_rows, {pe('count(*)', '(SELECT count(*) FROM facts)')} AS retained_percent FROM recipe""")
def _(t):
    return C.recipe_summary(t["facts"], C.recipe_cohort(t["facts"]))


_AUDIT = {c: r for c, r in S.RECIPE_RANGES.items() if c in {
    "CalcCementContent_lbs_yd3", "FlyAshContent_lbs_yd3", "calcWCRatio", "SandSSD_lbs_yd3", "AggregateSSD_lbs_yd3", "SandMoisture_percent",
    "AggregateMoisture_percent", "WaterAdded_gal_per_yd3", S.TARGET, S.REQUIRED, "EffectiveSlump_in", "EffectiveAir_percent"}}


@query("grp46_recipe_range_audit", cte("facts") + """, sc AS (SELECT * REPLACE (CASE WHEN CalcCementContent_lbs_yd3 IS NOT NULL AND FlyAshContent_lbs_yd3 IS NULL THEN 0 ELSE FlyAshContent_lbs_yd3 END AS FlyAshContent_lbs_yd3)
 FROM facts WHERE ConcreteTestUnitSystem = 0 AND IsValidCastDate = 1)""" + " UNION ALL".join(
    f" SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS invalid_replaced FROM sc" for c, (lo, hi) in _AUDIT.items()))
def _(t):
    return C.recipe_range_audit(t["facts"])


# ---------------------------------------------------------------- user filters
@query("flt14_15_user_filters", cte("facts") + """
SELECT testId, SupplierName, EffectiveSlump_in FROM facts WHERE lower(trim(SupplierName)) IN ('supplier 1', 'supplier  2') AND CAST(officeId AS STRING) IN ('2', '3', '7')
 AND EffectiveSlump_in >= 3 AND EffectiveSlump_in <= 20""")
def _(t):
    df = C.choose(C.choose(t["facts"], "SupplierName", [" Supplier 1", "SUPPLIER  2"]), "officeId", [2, "3", 7])
    return C.within(C.choose(df, "mixNumber", None), "EffectiveSlump_in", 3.0, 20.0).select("testId", "SupplierName", "EffectiveSlump_in")


@query("flt17_year_filters", cte("facts") + """
SELECT 'train' AS period, testId FROM facts WHERE year(castDate) <= 1998 UNION ALL SELECT 'external', testId FROM facts WHERE year(castDate) BETWEEN 1999 AND 2001""")
def _(t):
    a = C.until_year(t["facts"], 1998).select(F.lit("train").alias("period"), "testId")
    return a.unionByName(C.between_years(t["facts"], 1999, 2001).select(F.lit("external").alias("period"), "testId"))


# ---------------------------------------------------------------- bands
def _band(c, edges, labels, right):
    parts = []
    for lab, lo, hi in zip(labels, edges[:-1], edges[1:]):
        conds = []
        if lo != float("-inf"):
            conds.append(f"{c} {'>' if right else '>='} {lo}::DOUBLE")
        if hi != float("inf"):
            conds.append(f"{c} {'<=' if right else '<'} {hi}::DOUBLE")
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{lab}'")
    return "CASE WHEN " + c + " IS NULL THEN NULL " + " ".join(parts) + " END"


@query("prj42_43_bands", cte("facts") + f"""
SELECT testId, {_band(S.TARGET, C.STRENGTH_EDGES, C.STRENGTH_LABELS, False)} AS StrengthBand,
 {_band('calcWCRatio', C.RATIO_EDGES, C.interval_labels(C.RATIO_EDGES, False), False)} AS WCMRange,
 {_band(S.TARGET, C.ERROR_EDGES, C.interval_labels(C.ERROR_EDGES, True), True)} AS ErrorRange FROM facts""")
def _(t):
    return C.with_bands(t["facts"]).select("testId", "StrengthBand", "WCMRange", "ErrorRange")


@query("prj51_feature_projection", cte("facts") + f""" SELECT testId, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in [
    S.REQUIRED, *S.FRESH_COLUMNS, 'AmbientTemp_F', 'WaterAdded_gal_per_yd3', 'BatchToSampleMinutes', 'BatchToCastMinutes', *S.INDICATORS,
    'uwSlump_specMin', 'uwSlump_specMax', 'uwAir_specMin', 'uwAir_specMax'])} FROM facts""")
def _(t):
    return C.feature_frame(t["facts"], "Day0_FieldPlusSpec")


# ---------------------------------------------------------------- specimens
SCHEDULED = """, b AS (SELECT *, CAST(castDate + daysToAge * INTERVAL '1' DAY AS DATE) AS ScheduledBreakDate, testedOnDate AS ActualBreakDate,
   CAST(date_diff('day', castDate, testedOnDate) AS INT) AS ActualAgeDays, coalesce(RequiredStrength, DesignStrength) AS ApplicableSpecifiedStrength,
   CASE WHEN RequiredStrength IS NOT NULL THEN 'Required' WHEN DesignStrength IS NOT NULL THEN 'Design' END AS ApplicableStrengthType FROM specimens)
, sched AS (SELECT *, CAST(date_diff('day', ScheduledBreakDate, ActualBreakDate) AS INT) AS BreakDateDifferenceDays FROM b)
, routed AS (SELECT *, coalesce(BreakDateDifferenceDays BETWEEN -1 AND 1, false) AS TestedWithinOneDayOfSchedule, CASE WHEN wasFieldCured = 0 THEN 'standard' WHEN wasFieldCured = 1 THEN 'field'
   WHEN wasFieldCured IS NULL THEN 'unknown' ELSE 'unexpected' END AS CuringRoute FROM sched WHERE daysToAge = 28)
, std AS (SELECT * FROM routed WHERE CuringRoute = 'standard' AND calcCompressiveStrength > 0)"""


def scheduled(t: Tables):
    from pourstat.operators.extract import applicable

    return C.with_break_schedule(applicable(t["specimens"]))


def routed(t: Tables):
    return C.curing_route(scheduled(t))


@query("prj41_break_schedule", cte("specimens") + SCHEDULED + """
SELECT SpecimenRowId, ScheduledBreakDate, ActualBreakDate, ActualAgeDays, BreakDateDifferenceDays, coalesce(BreakDateDifferenceDays = 0, false) AS TestedExactlyOnSchedule,
 coalesce(BreakDateDifferenceDays BETWEEN -1 AND 1, false) AS TestedWithinOneDayOfSchedule FROM sched""")
def _(t):
    return scheduled(t).select(
        "SpecimenRowId", "ScheduledBreakDate", "ActualBreakDate", "ActualAgeDays", "BreakDateDifferenceDays", "TestedExactlyOnSchedule", "TestedWithinOneDayOfSchedule"
    )


@query("prj11_clock_minutes", cte("specimens") + f"""
SELECT SpecimenRowId, {R("CASE WHEN sampleTime <> 'late' THEN (date_diff('second', CAST(batchTime AS TIME), try_cast(sampleTime AS TIME))) / 60.0 END", 'BatchToSampleMinutes')} FROM specimens""")
def _(t):
    return rounded(t["specimens"].select("SpecimenRowId", E.clock_minutes("batchTime", "sampleTime").alias("BatchToSampleMinutes")))


@query("flt12_curing_routes", cte("specimens") + SCHEDULED + " SELECT SpecimenRowId, CuringRoute FROM routed")
def _(t):
    return routed(t).select("SpecimenRowId", "CuringRoute")


@query("flt13_specimen_issues", cte("specimens") + SCHEDULED + """
SELECT * FROM (SELECT SpecimenRowId, nullif(concat_ws(';', CASE WHEN SpecimenRowId IS NULL THEN 'NullSpecimenId' END,
  CASE WHEN count(*) OVER (PARTITION BY SpecimenRowId) > 1 THEN 'DuplicateSpecimenId' END,
  CASE WHEN CuringRoute = 'standard' AND (calcCompressiveStrength IS NULL OR calcCompressiveStrength <= 0) THEN 'InvalidStrength' END,
  CASE WHEN CuringRoute = 'standard' AND calcCompressiveStrength > 0 AND (ScheduledBreakDate IS NULL OR ActualBreakDate IS NULL OR NOT TestedWithinOneDayOfSchedule) THEN 'BreakDateIssue' END,
  CASE WHEN CuringRoute = 'standard' AND calcCompressiveStrength > 0 AND SpecifiedBreakAge <> 28 THEN 'SpecifiedAgeIssue' END,
  CASE WHEN CuringRoute = 'standard' AND calcCompressiveStrength > 0 AND ApplicableSpecifiedStrength IS NULL THEN 'MissingSpecification' END), '') AS SpecimenIssues FROM routed)
WHERE SpecimenIssues IS NOT NULL""")
def _(t):
    return C.specimen_issues(routed(t)).select("SpecimenRowId", "SpecimenIssues")


@query("grp12_strength_target", cte("specimens") + SCHEDULED + f"""
SELECT testId, count(*) AS StandardCuredSpecimenCount28, count(DISTINCT SpecimenRowId) AS UniqueStandardCuredSpecimenCount28,
 {R('avg(calcCompressiveStrength)', S.TARGET)}, min(calcCompressiveStrength) AS MinimumActualStrength28_psi, max(calcCompressiveStrength) AS MaximumActualStrength28_psi,
 {R('stddev_samp(calcCompressiveStrength)', 'ActualStrengthStdDev28_psi', 4)}, min(ActualAgeDays) AS MinimumActualAgeDays, max(ActualAgeDays) AS MaximumActualAgeDays,
 {R('avg(ActualAgeDays)', 'AverageActualAgeDays')}, {R('max(calcCompressiveStrength) - min(calcCompressiveStrength)', 'ActualStrengthRange28_psi')},
 {R('stddev_samp(calcCompressiveStrength) / avg(calcCompressiveStrength) * 100', 'ActualStrengthCV28_percent')} FROM std GROUP BY testId""")
def _(t):
    out = C.strength_target(C.standard_specimens(routed(t)))
    return rounded(out.withColumn("ActualStrengthStdDev28_psi", F.round("ActualStrengthStdDev28_psi", 4)))


_FIRSTS = ["SpecifiedBreakAge", "RequiredStrength", "DesignStrength", "ApplicableSpecifiedStrength", "ApplicableStrengthType"]


@query("grp13_specification_summary", cte("specimens") + SCHEDULED + f""", g AS (SELECT testId,
 {', '.join(f'arg_min({c}, SpecimenRowId) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in _FIRSTS)}, max(RequiredStrengthRowCount) AS RequiredStrengthRowCount,
 max(DesignStrengthRowCount) AS DesignStrengthRowCount FROM std GROUP BY testId)
SELECT *, ApplicableSpecifiedStrength IS NULL AS SpecifiedStrengthMissing, coalesce(SpecifiedBreakAge = 28, false) AS SpecifiedBreakAgeIs28,
 coalesce(RequiredStrengthRowCount, 0) > 1 OR coalesce(DesignStrengthRowCount, 0) > 1 AS MultipleStrengthRowsFlag FROM g""")
def _(t):
    return C.specification_summary(C.standard_specimens(routed(t)))


@query("grp14_mixed_curing", cte("specimens") + SCHEDULED + """
SELECT SpecimenRowId, testId, wasFieldCured FROM routed WHERE testId IN (SELECT testId FROM routed GROUP BY testId HAVING count(DISTINCT wasFieldCured) > 1)""")
def _(t):
    return C.mixed_curing_rows(routed(t)).select("SpecimenRowId", "testId", "wasFieldCured")


@query("win08_first_specimen_per_test", cte("specimens") + SCHEDULED + """
SELECT testId, SpecimenRowId, plantNumber FROM (SELECT *, row_number() OVER (PARTITION BY testId ORDER BY SpecimenRowId) AS rn FROM std) WHERE rn = 1""")
def _(t):
    return C.keep_first(C.standard_specimens(routed(t)), ["testId"], [F.col("SpecimenRowId")]).select("testId", "SpecimenRowId", "plantNumber")


@query("win07_duplicate_tests", cte("export_rows") + """
SELECT testId, projectId, CASE WHEN count(*) OVER (PARTITION BY testId) > 1 THEN 1 ELSE 0 END AS IsDuplicate FROM export_rows""")
def _(t):
    return C.mark_duplicates(t["export_rows"], "testId", "IsDuplicate").select("testId", "projectId", "IsDuplicate")


@query("grp34_grain_check", cte("export_rows") + """, n AS (SELECT CASE WHEN trim(projectId) <> '' THEN projectId END AS k FROM export_rows), c AS (SELECT k, count(*) AS n FROM n GROUP BY k)
SELECT CAST(sum(n) AS BIGINT) AS RowCount, count(k) AS DistinctKeys, CAST(coalesce(sum(CASE WHEN k IS NOT NULL AND n > 1 THEN n END), 0) AS BIGINT) AS RowsInRepeatedKeys,
 CAST(coalesce(sum(CASE WHEN k IS NULL THEN n END), 0) AS BIGINT) AS RowsWithoutKey FROM c""")
def _(t):
    return P.grain_check(C.blanks_to_null(t["export_rows"]), "projectId")
