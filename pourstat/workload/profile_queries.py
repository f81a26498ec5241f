"""Queries for profiles, audits and summaries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import clean as C
from pourstat.operators import profile as P
from pourstat.workload.clean_queries import CURING, FIRST, LAST, MARKED, pe
from pourstat.workload.registry import R, RS, Tables, query, rounded
from pourstat.workload.standins import VIEWS, cte

NUMERIC = [S.TARGET, S.REQUIRED, *S.FIELD_FEATURES]
TEXT = ["SupplierName", "plantNumber", "mixNumber", "InitialCuringConditionRaw"]
MIXED = [*TEXT, "officeId", "testSubTypeId", S.TARGET, "EffectiveAir_percent", "WaterAddedRaw", "HasWaterAdded"]


def union(parts) -> str:
    return " UNION ALL ".join(" " + p for p in parts)


@query("grp15_missingness", cte("facts") + union(
    f"""SELECT '{c}' AS "Column", count(*) AS RowCount, count({c}) AS NonMissingCount, count(*) - count({c}) AS MissingCount, count(DISTINCT {c}) AS UniqueNonNullCount,
    count(CASE WHEN try_cast({c} AS DOUBLE) = 0 THEN 1 END) AS ZeroCountNumericInterpretation, {pe(f'count(*) - count({c})', 'count(*)')} AS MissingPercent FROM facts""" for c in MIXED))
def _(t: Tables):
    return P.column_missingness(t["facts"], MIXED).drop("DType")


#: All columns of the facts stand-in; every line of its text ends with one.
FACT_COLUMNS = re.findall(r"AS (\w+),?$", VIEWS["facts"].split("FROM {orders}")[0].strip(), re.M)
_DTYPE = "CASE max(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' WHEN 'VARCHAR' THEN 'string' END"


@query("grp15_missingness_all_columns", cte("facts") + union(
    f"""SELECT '{c}' AS "Column", count(*) AS RowCount, count({c}) AS NonMissingCount, count(*) - count({c}) AS MissingCount, count(DISTINCT {c}) AS UniqueNonNullCount,
    count(CASE WHEN try_cast(CAST({c} AS VARCHAR) AS DOUBLE) = 0 THEN 1 END) AS ZeroCountNumericInterpretation, {pe(f'count(*) - count({c})', 'count(*)')} AS MissingPercent, {_DTYPE.format(c=c)} AS DType FROM facts""" for c in FACT_COLUMNS))
def _(t: Tables):
    return P.column_missingness(t["facts"])


_Q = {"P01": 0.01, "P05": 0.05, "P25": 0.25, "Median": 0.5, "P75": 0.75, "P95": 0.95, "P99": 0.99}
_ABSENT = "EffectiveUnknown_in"


@query("grp16_numeric_profile", cte("facts") + union(
    [f"""SELECT '{c}' AS "Column", count(*) AS RowCount, count({c}) AS NonMissingCount, count(*) - count({c}) AS MissingCount, count(CASE WHEN {c} = 0 THEN 1 END) AS ZeroCount,
    count(CASE WHEN {c} < 0 THEN 1 END) AS NegativeCount, {R(f'min({c})', 'Min')}, {R(f'avg({c})', 'Mean')}, {R(f'max({c})', 'Max')}, {R(f'stddev_samp({c})', 'Std')},
    {pe(f'count(*) - count({c})', 'count(*)')} AS MissingPercent, 1 AS PresentInFile, {', '.join(R(f'quantile_cont(CAST({c} AS DOUBLE), {p})', n) for n, p in _Q.items())} FROM facts""" for c in NUMERIC]
    + [f"""SELECT '{_ABSENT}', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM facts"""]))
def _(t):
    return rounded(P.numeric_profile(t["facts"], [*NUMERIC, _ABSENT]))


def _norm(c: str) -> str:
    return rf"nullif(regexp_replace(upper(trim({c})), '\s+', ' ', 'g'), '')"


@query("grp17_field_profile", cte("facts") + union(
    f"""SELECT '{c}' AS "Column", count(*) AS RowCount, count({c}) AS NonNullCount, count(DISTINCT {c}) AS UniqueCount, count(*) - count({c}) AS NullCount,
    {pe(f'count(*) - count({c})', 'count(*)')} AS NullPercent, {pe(f'count(DISTINCT {c})', f'count({c})')} AS UniquePercentOfNonNull, count({c}) = 0 AS IsAllNull,
    count(DISTINCT {c}) <= 1 AS IsConstant, count({c}) > 0 AND count(DISTINCT {c}) = count({c}) AS IsLikelyIdentifier,
    {f'count(DISTINCT {_norm(c)})' if c in TEXT else 'CAST(NULL AS BIGINT)'} AS NormalizedUniqueCount,
    {f'count(DISTINCT {c}) - count(DISTINCT {_norm(c)})' if c in TEXT else 'CAST(NULL AS BIGINT)'} AS PotentialFormattingDuplicateCount FROM facts""" for c in [*MIXED, 'testId']))
def _(t):
    return P.field_profile(t["facts"], [*MIXED, "testId"])


_STRINGS = [*TEXT, "SpecifiedBreakAgeIs28", "SpecifiedStrengthMissing"]


@query("grp17_field_profile_all_columns", cte("facts") + union(
    f"""SELECT '{c}' AS "Column", count(*) AS RowCount, count({c}) AS NonNullCount, count(DISTINCT {c}) AS UniqueCount, count(*) - count({c}) AS NullCount,
    {pe(f'count(*) - count({c})', 'count(*)')} AS NullPercent, {pe(f'count(DISTINCT {c})', f'count({c})')} AS UniquePercentOfNonNull, count({c}) = 0 AS IsAllNull,
    count(DISTINCT {c}) <= 1 AS IsConstant, count({c}) > 0 AND count(DISTINCT {c}) = count({c}) AS IsLikelyIdentifier,
    {f'count(DISTINCT {_norm(c)})' if c in _STRINGS else 'CAST(NULL AS BIGINT)'} AS NormalizedUniqueCount,
    {f'count(DISTINCT {c}) - count(DISTINCT {_norm(c)})' if c in _STRINGS else 'CAST(NULL AS BIGINT)'} AS PotentialFormattingDuplicateCount FROM facts""" for c in FACT_COLUMNS))
def _(t):
    return P.field_profile(t["facts"])


@query("grp18_category_frequency", cte("facts") + union(
    f"""SELECT '{c}' AS "Column", coalesce({c}, '<missing>') AS "Value", count(*) AS TestCount, {pe('count(*)', '(SELECT count(*) FROM facts)')} AS Percent FROM facts GROUP BY 2""" for c in TEXT))
def _(t):
    return P.category_frequency(t["facts"], TEXT)


@query("win10_top_values", cte("facts") + ", v AS (" + union(f"""SELECT '{c}' AS "Column", {c} AS OriginalValue, count(*) AS n FROM facts GROUP BY 2""" for c in TEXT) + f"""),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "Column" ORDER BY n DESC, OriginalValue NULLS FIRST) AS INT) AS "Rank" FROM v)
SELECT "Column", OriginalValue, n AS "Count", "Rank", {_norm('OriginalValue')} AS NormalizedComparisonValue, {pe('n', '(SELECT count(*) FROM facts)')} AS Percent FROM r WHERE "Rank" <= 30""")
def _(t):
    return P.top_values(t["facts"], TEXT, 30)


@query("grp19_formatting_variants", cte("facts") + ", v AS (" + union(f"""SELECT '{c}' AS "Column", {c} AS v, count(*) AS n FROM facts WHERE {c} IS NOT NULL GROUP BY 2""" for c in TEXT) + f""")
SELECT "Column", {_norm('v')} AS NormalizedValue, count(*) AS OriginalVariantCount, CAST(sum(n) AS BIGINT) AS TotalRowCount, string_agg(v, ' | ' ORDER BY v) AS OriginalVariants
FROM v WHERE {_norm('v')} IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return P.formatting_variants(t["facts"], TEXT)


@query("grp20_curing_text_frequency", cte("facts") + f"""
SELECT coalesce({CURING}, '<missing>') AS InitialCuringConditionNormalizedText, count(*) AS TestCount, {pe('count(*)', '(SELECT count(*) FROM facts)')} AS Percent FROM facts GROUP BY 1""")
def _(t):
    return P.curing_text_frequency(t["facts"], "InitialCuringConditionRaw")


@query("grp20_curing_text_stats", cte("facts") + f""", c AS (SELECT {CURING} AS x, count(*) AS n FROM facts GROUP BY 1)
SELECT CAST(sum(CASE WHEN x IS NOT NULL THEN n END) AS BIGINT) AS InitialCuringNonMissingCount, CAST(sum(CASE WHEN x IS NULL THEN n END) AS BIGINT) AS InitialCuringMissingCount,
 count(x) AS InitialCuringUniqueCleanCount, count(CASE WHEN x IS NOT NULL AND n = 1 THEN 1 END) AS InitialCuringSingleOccurrenceValueCount FROM c""")
def _(t):
    return P.curing_text_stats(t["facts"], "InitialCuringConditionRaw")


# ---------------------------------------------------------------- not-applicable audit
_PAIRS = [
    ("WaterAddedRaw", "waterAddedNA", "Water added"),
    ("LoadBatchVolumeRaw", "LoadBatchVolumeNA", "Load/batch volume"),
    ("uwSlump_specMin", None, "Slump spec minimum"),
    ("uwSlump_specMax", None, "Slump spec maximum"),
    ("uwAir_specMin", None, "Air spec minimum"),
    ("uwAir_specMax", None, "Air spec maximum"),
]


def _pair(raw, na, label, extra=""):
    n = na or "CAST(NULL AS INT)"
    q = f"'{na}'" if na else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{label}' AS Field, '{raw}' AS RawColumn, {q} AS NAFlagColumn, {raw} AS r, {n} AS f{extra} FROM facts"


@query("grp21_na_audit", cte("facts") + ", p AS (" + union(_pair(*p) for p in _PAIRS) + """)
SELECT Field, RawColumn, NAFlagColumn, count(*) AS TotalRows, count(r) AS RawNonMissingCount, count(*) - count(r) AS RawMissingCount, count(f) AS NAFlagPopulatedCount,
 count(*) - count(f) AS NAFlagNullCount, count(CASE WHEN f = 1 THEN 1 END) AS NAFlagTrueCount, count(CASE WHEN f = 0 THEN 1 END) AS NAFlagFalseCount, count(CASE WHEN r = 0 THEN 1 END) AS RawZeroCount,
 count(CASE WHEN r = 0 AND f = 1 THEN 1 END) AS ZeroWithNAFlagTrueCount, count(CASE WHEN r = 0 AND f = 0 THEN 1 END) AS ZeroWithNAFlagFalseCount,
 count(CASE WHEN r = 0 AND f IS NULL THEN 1 END) AS ZeroWithNAFlagNull_AmbiguousCount, count(CASE WHEN r > 0 AND f = 1 THEN 1 END) AS PositiveValueWithNAFlagTrue_ConflictCount,
 count(CASE WHEN r IS NULL AND f = 0 THEN 1 END) AS MissingRawWithNAFlagFalseCount FROM p GROUP BY 1, 2, 3""")
def _(t):
    return P.na_audit(t["facts"])


@query("grp22_na_audit_by_year", cte("facts") + ", p AS (" + union(_pair(*p, extra=", CAST(year(castDate) AS INT) AS CastYear") for p in _PAIRS) + """)
SELECT Field, CastYear, count(*) AS RowCount, count(r) AS RawPresentCount, count(f) AS NAFlagPresentCount, count(CASE WHEN f = 1 THEN 1 END) AS NAFlagTrueCount,
 count(CASE WHEN r = 0 THEN 1 END) AS RawZeroCount, count(CASE WHEN r = 0 AND f IS NULL THEN 1 END) AS ZeroWithNAFlagNull_AmbiguousCount FROM p WHERE CastYear IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return P.na_audit_by_year(t["facts"])


AMBIGUOUS = " + ".join(f"CAST(coalesce({r} = 0, false) AND {n + ' IS NULL' if n else 'true'} AS INT)" for r, n, _ in _PAIRS)


@query("grp22_row_ambiguity", cte("facts") + f" SELECT testId, {AMBIGUOUS} AS LegacyZeroNAAmbiguityCount FROM facts")
def _(t):
    df = t["facts"]
    return df.select("testId", P.ambiguous_zero_count(df).alias("LegacyZeroNAAmbiguityCount"))


# All 23 pairs, from the measured values and flags of the test table.
_AUDITED = cte("concrete_tests") + """, a AS (SELECT *, testbaseId AS testId, waterAdded AS WaterAddedRaw, batchSize AS LoadBatchVolumeRaw, LoadBatchVolumneNA AS LoadBatchVolumeNA, ambientTemp AS AmbientTempRaw FROM concrete_tests)
, p AS (""" + union(
    f"SELECT '{label}' AS Field, '{raw}' AS RawColumn, '{na}' AS NAFlagColumn, testId, CAST(year(castDate) AS INT) AS CastYear, {raw} AS r, {na} AS f FROM a" for raw, na, label in S.NA_PAIRS
) + ")"


def audited(t: Tables):
    named = {"testId": "testbaseId", "WaterAddedRaw": "waterAdded", "LoadBatchVolumeRaw": "batchSize", "LoadBatchVolumeNA": "LoadBatchVolumneNA", "AmbientTempRaw": "ambientTemp"}
    return t["concrete_tests"].withColumns({n: F.col(c) for n, c in named.items()})


@query("grp21_na_audit_all_pairs", _AUDITED + """
SELECT Field, RawColumn, NAFlagColumn, count(*) AS TotalRows, count(r) AS RawNonMissingCount, count(*) - count(r) AS RawMissingCount, count(f) AS NAFlagPopulatedCount,
 count(*) - count(f) AS NAFlagNullCount, count(CASE WHEN f = 1 THEN 1 END) AS NAFlagTrueCount, count(CASE WHEN f = 0 THEN 1 END) AS NAFlagFalseCount, count(CASE WHEN r = 0 THEN 1 END) AS RawZeroCount,
 count(CASE WHEN r = 0 AND f = 1 THEN 1 END) AS ZeroWithNAFlagTrueCount, count(CASE WHEN r = 0 AND f = 0 THEN 1 END) AS ZeroWithNAFlagFalseCount,
 count(CASE WHEN r = 0 AND f IS NULL THEN 1 END) AS ZeroWithNAFlagNull_AmbiguousCount, count(CASE WHEN r > 0 AND f = 1 THEN 1 END) AS PositiveValueWithNAFlagTrue_ConflictCount,
 count(CASE WHEN r IS NULL AND f = 0 THEN 1 END) AS MissingRawWithNAFlagFalseCount FROM p GROUP BY 1, 2, 3""")
def _(t):
    return P.na_audit(audited(t))


@query("grp22_na_audit_by_year_all_pairs", _AUDITED + """
SELECT Field, CastYear, count(*) AS RowCount, count(r) AS RawPresentCount, count(f) AS NAFlagPresentCount, count(CASE WHEN f = 1 THEN 1 END) AS NAFlagTrueCount,
 count(CASE WHEN r = 0 THEN 1 END) AS RawZeroCount, count(CASE WHEN r = 0 AND f IS NULL THEN 1 END) AS ZeroWithNAFlagNull_AmbiguousCount FROM p WHERE CastYear IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return P.na_audit_by_year(audited(t))


@query("grp22_row_ambiguity_all_pairs", _AUDITED + " SELECT testId, count(*) FILTER (r = 0 AND f IS NULL) AS LegacyZeroNAAmbiguityCount FROM p GROUP BY 1")
def _(t):
    df = audited(t)
    return df.select("testId", P.ambiguous_zero_count(df).cast("long").alias("LegacyZeroNAAmbiguityCount"))


# ---------------------------------------------------------------- curing
def _has(kind: str, age: int) -> str:
    return f"coalesce({kind}Strength{age}SpecimenCount, 0) > 0"


def _cls(age: int) -> str:
    s, f = _has("Actual", age), _has("FieldCured", age)
    return f"CASE WHEN {s} AND {f} THEN 'Both standard and field cured' WHEN {s} THEN 'Standard cured only' WHEN {f} THEN 'Field cured only' ELSE 'No strength result' END"


CLASSED = f", classed AS (SELECT *, {_cls(7)} AS CuringAvailability7, {_cls(28)} AS CuringAvailability28 FROM facts)"


@query("grp23_curing_class", cte("facts") + CLASSED + f""" SELECT testId, CuringAvailability7, CuringAvailability28, CAST({_has('Actual', 28)} AS INT) AS HasStandardCured28,
 CAST({_has('FieldCured', 28)} AS INT) AS HasFieldCured28 FROM classed""")
def _(t):
    return P.with_curing_class(t["facts"]).select("testId", "CuringAvailability7", "CuringAvailability28", "HasStandardCured28", "HasFieldCured28")


@query("grp23_curing_summary", cte("facts") + CLASSED + union(
    f"""SELECT {a} AS BreakAgeDays, '{c}' AS CuringResultAvailability, count(CASE WHEN CuringAvailability{a} = '{c}' THEN 1 END) AS ConcreteTestCount,
    {pe(f"count(CASE WHEN CuringAvailability{a} = '{c}' THEN 1 END)", 'count(*)')} AS Percent FROM classed""" for a in (7, 28) for c in S.CURING_CLASSES))
def _(t):
    return P.curing_summary(P.with_curing_class(t["facts"]))


@query("grp49_win04_curing_by_year", cte("facts") + CLASSED + f""", c AS (SELECT CAST(year(castDate) AS INT) AS CastYear, CuringAvailability28, count(*) AS ConcreteTestCount FROM classed WHERE castDate IS NOT NULL GROUP BY 1, 2)
SELECT *, {pe('ConcreteTestCount', 'sum(ConcreteTestCount) OVER (PARTITION BY CastYear)')} AS PercentWithinYear FROM c""")
def _(t):
    return P.curing_breakdown(P.with_curing_class(t["facts"]), F.year("castDate"), "CastYear", "PercentWithinYear", False)


@query("grp49_win04_curing_by_office", cte("facts") + CLASSED + f""", c AS (SELECT CAST(officeId AS VARCHAR) AS Office, CuringAvailability28, count(*) AS ConcreteTestCount FROM classed GROUP BY 1, 2)
SELECT *, {pe('ConcreteTestCount', 'sum(ConcreteTestCount) OVER (PARTITION BY Office)')} AS PercentWithinOffice FROM c""")
def _(t):
    office = F.coalesce(F.col("officeId").cast("string"), F.lit(P.MISSING_VALUE))
    return P.curing_breakdown(P.with_curing_class(t["facts"]), office, "Office", "PercentWithinOffice", True)


_FRESH = "coalesce(EffectiveSlump_in, EffectiveSpread_in, EffectiveAir_percent, EffectiveUnitWeight_lb_ft3, EffectiveConcreteTemp_F)"


@query("grp24_subtype_readiness", cte("facts") + f"""
SELECT coalesce(CAST(testSubTypeId AS VARCHAR), '<missing>') AS testSubTypeId, count(*) AS ConcreteTestCount, count(AverageActualStrength7_psi) AS TestsWithActual7,
 count(AverageActualStrength28_psi) AS TestsWithActual28, count(ApplicableSpecifiedStrength28) AS TestsWithRequired28, count({_FRESH}) AS TestsWithAnyFreshMeasurement,
 count(CASE WHEN {_has('Actual', 28)} THEN 1 END) AS TestsWithStandardCured28, count(CASE WHEN {_has('FieldCured', 28)} THEN 1 END) AS TestsWithFieldCured28,
 {pe('count(AverageActualStrength28_psi)', 'count(*)')} AS Actual28CoveragePercent, {pe(f'count({_FRESH})', 'count(*)')} AS FreshMeasurementCoveragePercent,
 {pe(f"count(CASE WHEN {_has('FieldCured', 28)} THEN 1 END)", 'count(*)')} AS FieldCured28Percent FROM facts GROUP BY 1""")
def _(t):
    return P.subtype_readiness(P.with_curing_class(t["facts"]))


# ---------------------------------------------------------------- summaries
_SETS = {k: list(dict.fromkeys(v)) for k, v in S.FEATURE_SETS.items()}
_FACT_COLS = set(NUMERIC + S.FRESH_COLUMNS + ["uwSlump_specMin", "uwSlump_specMax", "uwAir_specMin", "uwAir_specMax", "SlumpOutOfSpecFlag", "AirOutOfSpecFlag", S.DAY7, S.DAY7_COUNT])


@query("grp28_feature_coverage", cte("facts") + union(
    f"""SELECT '{s}' AS feature_set, '{c}' AS "column", {int(c in _FACT_COLS)} AS column_present, {f'count({c})' if c in _FACT_COLS else 'CAST(0 AS BIGINT)'} AS non_null_count,
    {pe(f'count({c})' if c in _FACT_COLS else '0', 'count(*)')} AS coverage_percent FROM facts""" for s, cs in _SETS.items() for c in cs))
def _(t):
    return P.feature_coverage(t["facts"])


_FAIL = "CASE WHEN AverageActualStrength28_psi IS NULL OR ApplicableSpecifiedStrength28 IS NULL THEN NULL WHEN AverageActualStrength28_psi < ApplicableSpecifiedStrength28 THEN 1 ELSE 0 END"


@query("grp29_cohort_summary", cte("facts") + f""", c AS (SELECT AverageActualStrength28_psi AS y, ApplicableSpecifiedStrength28 AS r, AverageActualStrength7_psi AS d, {_FAIL} AS f FROM facts)
SELECT 'all_cleaned_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM c UNION ALL SELECT 'regression_eligible_rows', count(CASE WHEN y IS NOT NULL AND r IS NOT NULL THEN 1 END) FROM c
UNION ALL SELECT 'classification_eligible_rows', count(f) FROM c UNION ALL SELECT 'day7_eligible_rows', count(CASE WHEN f IS NOT NULL AND d IS NOT NULL THEN 1 END) FROM c
UNION ALL SELECT 'failure_rows', sum(f) FROM c UNION ALL SELECT 'failure_rate_percent', {pe('sum(f)', 'count(f)', 3)} FROM c""")
def _(t):
    return P.cohort_summary(C.with_recomputed_failure(t["facts"]))


def _ov(name, cond):
    n = f"count(CASE WHEN {cond} THEN 1 END)"
    return f"SELECT '{name}' AS Metric, CAST({n} AS VARCHAR) AS CountOrValue, {pe(n, 'count(*)')} AS PercentOfAllRows FROM o"


@query("grp26_preparation_overview", cte("facts") + MARKED + f", o AS (SELECT *, {AMBIGUOUS} AS amb, {_cls(28)} AS c28 FROM marked)" + union([
    f"SELECT 'Total records' AS Metric, CAST(count(*) AS VARCHAR) AS CountOrValue, {pe('count(*)', 'count(*)')} AS PercentOfAllRows FROM o",
    f"SELECT 'Unique concrete tests', CAST(count(DISTINCT testId) AS VARCHAR), {pe('count(DISTINCT testId)', 'count(*)')} FROM o",
    _ov("Rows belonging to duplicated test IDs", "DuplicateTestId = 1"), _ov("US unit-system rows", "ValidUSUnitSystem = 1"),
    _ov("Rows with valid cast date", "ValidCastDateForModel = 1"), _ov("Rows with actual 7-day standard-cured strength", "AverageActualStrength7_psi IS NOT NULL"),
    _ov("Rows with actual 28-day standard-cured strength", "AverageActualStrength28_psi IS NOT NULL"),
    _ov("Rows with applicable required/design 28-day strength", "ApplicableSpecifiedStrength28 IS NOT NULL"),
    _ov("Rows with any effective fresh measurement", "AvailableFreshMeasurementCount > 0"), _ov("Rows with all effective fresh measurements", "AvailableFreshMeasurementCount = 5"),
    _ov("Field Core base model candidates", "FieldCoreBaseEligible = 1"), _ov("Field Core candidates with required strength", "FieldCoreWithRequiredEligible = 1"),
    _ov("Complete-case Field Core candidates", "FieldCoreCompleteCase = 1"), _ov("Rows with at least one ambiguous legacy zero/N/A pair", "amb > 0"),
    _ov("28-day standard-cured only", "c28 = 'Standard cured only'"), _ov("28-day field-cured only", "c28 = 'Field cured only'"),
    _ov("28-day both standard and field cured", "c28 = 'Both standard and field cured'"), _ov("28-day no strength result", "c28 = 'No strength result'"),
    "SELECT 'Earliest valid cast date', CAST(min(CASE WHEN ValidCastDateForModel = 1 THEN castDate END) AS VARCHAR), NULL FROM o",
    "SELECT 'Latest valid cast date', CAST(max(CASE WHEN ValidCastDateForModel = 1 THEN castDate END) AS VARCHAR), NULL FROM o"]))
def _(t):
    df = P.with_curing_class(C.mark_candidates(t["facts"], FIRST, LAST))
    return P.preparation_overview(df.withColumn("LegacyZeroNAAmbiguityCount", P.ambiguous_zero_count(df)))


@query("grp47_spearman", cte("facts") + f""", c AS (SELECT testId, calcWCRatio AS a, CalcCementContent_lbs_yd3 AS b, AverageActualStrength28_psi AS y FROM facts
   WHERE calcWCRatio IS NOT NULL AND CalcCementContent_lbs_yd3 IS NOT NULL AND AverageActualStrength28_psi IS NOT NULL)
, k AS (SELECT {', '.join(f'rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE AS r{x}' for x in 'aby')} FROM c)
""" + union(f"""SELECT '{n1}' AS "Column", '{n2}' AS OtherColumn, {R(f'corr(r{x}, r{z})', 'Spearman')} FROM k"""
    for n1, x in (("calcWCRatio", "a"), ("CalcCementContent_lbs_yd3", "b"), (S.TARGET, "y")) for n2, z in (("calcWCRatio", "a"), ("CalcCementContent_lbs_yd3", "b"), (S.TARGET, "y"))))
def _(t):
    return rounded(P.spearman(t["facts"], "testId", ["calcWCRatio", "CalcCementContent_lbs_yd3", S.TARGET]))


@query("grp48_histogram", cte("facts") + f""", m AS (SELECT min({S.TARGET}) AS lo, (max({S.TARGET}) - min({S.TARGET})) / 50 AS w FROM facts)
SELECT CAST(least(floor(({S.TARGET} - lo) / w), 49) AS INT) AS Bin, {R('any_value(lo) + least(floor((any_value(' + S.TARGET + ') - any_value(lo)) / any_value(w)), 49) * any_value(w)', 'BinStart')},
 count(*) AS RowCount FROM facts, m WHERE {S.TARGET} IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(P.histogram(t["facts"], S.TARGET, 50))


@query("grp48_box_statistics", cte("facts") + f"""
SELECT SupplierName, count(*) AS RowCount, min({S.TARGET}) AS "Min", max({S.TARGET}) AS "Max", {', '.join(R(f'quantile_cont({S.TARGET}, {p})', n) for n, p in (('P25', 0.25), ('Median', 0.5), ('P75', 0.75)))}
FROM facts WHERE SupplierName IS NOT NULL AND {S.TARGET} IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def _(t):
    return rounded(P.box_statistics(t["facts"], "SupplierName", S.TARGET))
