"""Cleaning: parsing, ranges, exclusion reasons, cohorts and quality extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators.order_stats import join_on, selected_quantiles, top_rows


# --------------------------------------------------------------------------
# Whole-frame parsing
# --------------------------------------------------------------------------
def blanks_to_null(df: DataFrame, tokens: Sequence[str] = tuple(S.NULL_TOKENS)) -> DataFrame:
    """Trim every text column and turn null tokens into NULL."""
    return df.select(
        *[
            E.null_tokens(f.name, tokens).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse the listed columns, where present, to double."""
    return df.withColumns({c: E.number(c) for c in columns if c in df.columns})


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


# --------------------------------------------------------------------------
# Duplicates
# --------------------------------------------------------------------------
def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("RowCount")).where(F.col("RowCount") > 1)


def mark_duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    """1 on every row of a repeated key, else 0.

    The keys are counted with a map-side combine and joined back; a hot key is split
    by the adaptive skew join instead of filling one window task.
    """
    repeated = duplicate_keys(df, key).select(key, F.lit(1).alias(name))
    return join_on(df, repeated, [key], "left", null_safe=True).withColumn(
        name, F.coalesce(F.col(name), F.lit(0))
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in a total order."""
    return top_rows(df, keys, order, 1)


# --------------------------------------------------------------------------
# Ranges
# --------------------------------------------------------------------------
def null_outside(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside their closed range become NULL; rows stay."""
    return df.withColumns({c: E.in_range(c, lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns})


def range_audit(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per configured column: presence, limits and values that will be nulled."""
    counted = df.agg(
        *[
            (E.count_if(E.outside(c, lo, hi)) if c in df.columns else F.lit(0).cast("long")).alias(c)
            for c, (lo, hi) in ranges.items()
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("Column"),
            F.lit(int(c in df.columns)).alias("PresentInInput"),
            F.lit(float(lo)).alias("MinimumAllowed"),
            F.lit(float(hi)).alias("MaximumAllowed"),
            F.col(c).alias("ValuesSetToMissing"),
        )
        for c, (lo, hi) in ranges.items()
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# --------------------------------------------------------------------------
# Field-core cleaning
# --------------------------------------------------------------------------
def clean_export(df: DataFrame, first_day: str, last_day: str, unit_system: int = S.US_UNIT_SYSTEM) -> DataFrame:
    """Typed columns, out-of-range values nulled, review flags and exclusion reasons."""
    df = blanks_to_null(df, [""])
    features = present(df, list(S.CLEAN_RANGES) + S.INDICATORS)
    df = numbers(df, [S.TARGET, S.REQUIRED, "ConcreteTestUnitSystem", *features])
    df = df.withColumn("castDate", E.day("castDate") if "castDate" in df.columns else F.lit(None).cast("date"))
    if "ConcreteTestUnitSystem" not in df.columns:
        df = df.withColumn("ConcreteTestUnitSystem", F.lit(float(unit_system)))
    if S.REQUIRED not in df.columns:
        df = df.withColumn(S.REQUIRED, F.lit(None).cast("double"))
    df = mark_duplicates(df, "testId", "_duplicate")

    target, required = F.col(S.TARGET), F.col(S.REQUIRED)
    review: dict[str, Column] = {}
    cleaned: dict[str, Column] = {}
    for c, (lo, hi) in S.CLEAN_RANGES.items():
        if c in df.columns:
            review[f"{c}_OutOfRange"] = E.flag(E.outside(c, lo, hi))
            cleaned[c] = E.in_range(c, lo, hi)
    for c in present(df, S.INDICATORS):
        review[f"{c}_InvalidIndicator"] = E.flag(E.known_true(~F.col(c).isin(0.0, 1.0)))
        cleaned[c] = F.when(F.col(c).isin(0.0, 1.0), F.col(c))
    in_limits = (required > 0) & (required <= S.MAX_STRENGTH_PSI)
    review["TargetBelow1000Psi_Review"] = E.flag((target > 0) & (target < S.LOW_STRENGTH_REVIEW_PSI))
    review["RequiredStrengthInvalid"] = E.flag(E.known_true(~in_limits))
    review["RequiredStrengthBelow1000Psi_Review"] = E.flag(
        (required > 0) & (required < S.LOW_STRENGTH_REVIEW_PSI)
    )
    cleaned[S.REQUIRED] = F.when(in_limits, required)

    df = df.withColumns(review).withColumns(cleaned)
    valid_target = (target > 0) & (target <= S.MAX_STRENGTH_PSI)
    any_core = E.has_any(present(df, S.CORE_FRESH))
    return df.withColumns(
        {
            "CleaningReviewFlagCount": sum((F.col(c) for c in review), F.lit(0)),
            "HasAnyCoreMeasurementAfterCleaning": E.flag(any_core),
            "CleaningExclusionReasons": E.reasons(
                [
                    ("DuplicateTestId", F.col("_duplicate") == 1),
                    ("NonUSUnitSystem", ~E.known_true(F.col("ConcreteTestUnitSystem") == unit_system)),
                    (
                        "InvalidCastDate",
                        ~E.known_true(
                            F.col("castDate").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
                        ),
                    ),
                    ("Invalid28DayTarget", ~E.known_true(valid_target)),
                    ("NoUsableCoreFreshMeasurement", ~any_core),
                ]
            ),
        }
    ).withColumn("HasCleaningReviewFlag", E.flag(F.col("CleaningReviewFlagCount") > 0)).drop("_duplicate")


def clean_cohorts(cleaned: DataFrame) -> dict[str, DataFrame]:
    """Base rows, rows with a requirement, excluded rows and rows to review."""
    kept = cleaned.where(F.col("CleaningExclusionReasons").isNull())
    return {
        "clean_base": kept,
        "clean_with_required": kept.where(F.col(S.REQUIRED).isNotNull()),
        "excluded": cleaned.where(F.col("CleaningExclusionReasons").isNotNull()),
        "review": cleaned.where(F.col("HasCleaningReviewFlag") == 1),
    }


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """One-row run record of the cleaning step."""
    kept = F.col("CleaningExclusionReasons").isNull()
    return cleaned.agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_distinct("testId").alias("unique_tests"),
        E.count_if(kept).alias("clean_base_records"),
        E.count_if(kept & F.col(S.REQUIRED).isNotNull()).alias("clean_with_required_records"),
        E.count_if(~kept).alias("excluded_records"),
        F.sum("HasCleaningReviewFlag").alias("records_with_review_flags"),
    )


def external_reasons(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Exclusion reasons of the later-years set used for external validation."""
    df = mark_duplicates(df, "testId", "_duplicate")

    def bad(c: str) -> Column:
        return ~E.known_true((F.col(c) > 0) & (F.col(c) <= S.MAX_STRENGTH_PSI))

    year = F.year("castDate")
    return df.withColumns(
        {
            "ExternalValidationYear": year,
            "ExternalExclusionReasons": E.reasons(
                [
                    ("OutsideExternalYearRange", ~E.known_true(year.between(first_year, last_year))),
                    ("NonUSUnitSystem", ~E.known_true(F.col("ConcreteTestUnitSystem") == S.US_UNIT_SYSTEM)),
                    ("InvalidActualStrength28", bad(S.TARGET)),
                    ("InvalidRequiredStrength28", bad(S.REQUIRED)),
                    ("DuplicateTestId", F.col("_duplicate") == 1),
                ]
            ),
        }
    ).drop("_duplicate")


def year_summary(external: DataFrame) -> DataFrame:
    """Rows, tests and mean strengths per year of the accepted external rows."""
    return (
        external.where(F.col("ExternalExclusionReasons").isNull())
        .groupBy("ExternalValidationYear")
        .agg(
            F.count(F.lit(1)).alias("RowCount"),
            F.count_distinct("testId").alias("UniqueTests"),
            F.avg(S.TARGET).alias("ActualStrength28Mean"),
            F.avg(S.REQUIRED).alias("RequiredStrength28Mean"),
        )
    )


# --------------------------------------------------------------------------
# Model candidates
# --------------------------------------------------------------------------
def mark_candidates(df: DataFrame, first_day: str, last_day: str, unit_system: int = S.US_UNIT_SYSTEM) -> DataFrame:
    """Eligibility flags and reasons of the field-core model sets."""
    fresh = present(df, S.FRESH_COLUMNS)
    df = mark_duplicates(df, "testId", "DuplicateTestId")
    unit = E.known_true(F.col("ConcreteTestUnitSystem") == unit_system)
    date = E.known_true(F.col("castDate").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    target, required = E.known_true(F.col(S.TARGET) > 0), E.known_true(F.col(S.REQUIRED) > 0)
    any_fresh, unique = E.has_any(fresh), F.col("DuplicateTestId") == 0
    eligible = unit & date & target & any_fresh & unique
    return df.withColumns(
        {
            "AvailableFreshMeasurementCount": sum((E.flag(F.col(c).isNotNull()) for c in fresh), F.lit(0)),
            "ValidUSUnitSystem": E.flag(unit),
            "ValidCastDateForModel": E.flag(date),
            "ValidStandardCured28Target": E.flag(target),
            "HasRequiredStrength28": E.flag(required),
            "HasAnyCoreFreshMeasurement": E.flag(any_fresh),
            "FieldCoreBaseEligible": E.flag(eligible),
            "FieldCoreWithRequiredEligible": E.flag(eligible & required),
            "FieldCoreCompleteCase": E.flag(
                eligible & F.forall(F.array(*[F.col(c).cast("double") for c in present(df, S.FIELD_FEATURES)]), lambda v: v.isNotNull())
            ),
            "BaseExclusionReasons": E.reasons(
                [
                    ("DuplicateTestId", ~unique),
                    ("NonUSUnitSystem", ~unit),
                    ("InvalidOrMissingCastDate", ~date),
                    ("MissingOrNonPositiveStandardCured28Strength", ~target),
                    ("NoEffectiveFreshMeasurement", ~any_fresh),
                ]
            ),
        }
    )


# --------------------------------------------------------------------------
# Suspicious values
# --------------------------------------------------------------------------
SUSPICIOUS_FLAGS = S.SUSPICIOUS_FLAGS


SUSPICIOUS_COLUMNS = [
    S.TARGET, S.REQUIRED, "EffectiveSlump_in", "EffectiveSpread_in", "EffectiveAir_percent", "EffectiveUnitWeight_lb_ft3",
    "WaterAdded_gal_per_yd3", "LoadBatchVolumeRaw", "BatchToSampleMinutes", "BatchToCastMinutes",
]


def suspicious_flags(df: DataFrame) -> DataFrame:
    """Ten value rules and a 3-IQR fence on strength (from 8 values on). An absent column counts as missing."""
    absent = {c: F.lit(None).cast("double") for c in SUSPICIOUS_COLUMNS if c not in df.columns}
    df = df.withColumns(absent)
    quartiles = selected_quantiles(df, [], S.TARGET, {"q1": 0.25, "q3": 0.75})
    counted = df.agg(F.count(S.TARGET).alias("n"))
    fence = F.struct("q1", "q3")
    df = df.withColumns({"_fence": quartiles.select(fence).scalar(), "_n": counted.scalar()})
    q1, q3 = F.col("_fence.q1"), F.col("_fence.q3")
    reach = (q3 - q1) * 3.0
    target = F.col(S.TARGET)
    rules = [
        target <= 0,
        F.col(S.REQUIRED) <= 0,
        F.col("EffectiveSlump_in") < 0,
        F.col("EffectiveSpread_in") < 0,
        F.col("EffectiveAir_percent") < 0,
        F.col("EffectiveUnitWeight_lb_ft3") <= 0,
        F.col("WaterAdded_gal_per_yd3") < 0,
        F.col("LoadBatchVolumeRaw") <= 0,
        F.col("BatchToSampleMinutes") > S.MINUTES_PER_DAY,
        F.col("BatchToCastMinutes") > S.MINUTES_PER_DAY,
        (F.col("_n") >= 8) & ((target < q1 - reach) | (target > q3 + reach)),
    ]
    df = df.withColumns({n: E.flag(r) for n, r in zip(SUSPICIOUS_FLAGS, rules)}).drop("_fence", "_n")
    df = df.withColumn("SuspiciousValueFlagCount", sum((F.col(n) for n in SUSPICIOUS_FLAGS), F.lit(0)))
    df = df.withColumn("HasSuspiciousValue", E.flag(F.col("SuspiciousValueFlagCount") > 0))
    return df.drop(*absent)


# Review limits of a recipe
RECIPE_REVIEW = {
    "SuspiciousWCM": ("calcWCRatio", 0.20, 0.90),
    "SuspiciousCement": ("CalcCementContent_lbs_yd3", 200.0, 1200.0),
    "SuspiciousSand": ("SandSSD_lbs_yd3", 300.0, 3500.0),
    "SuspiciousAggregate": ("AggregateSSD_lbs_yd3", 300.0, 3500.0),
    "SuspiciousSandMoisture": ("SandMoisture_percent", -10.0, 20.0),
    "SuspiciousAggregateMoisture": ("AggregateMoisture_percent", -10.0, 20.0),
}


def suspicious_recipes(df: DataFrame) -> DataFrame:
    """Rows with any recipe value outside its review limits; missing counts as outside."""
    flags = {n: E.flag(~E.known_true(F.col(c).between(lo, hi))) for n, (c, lo, hi) in RECIPE_REVIEW.items()}
    return df.withColumns(flags).where(F.greatest(*[F.col(n) for n in flags]) == 1)


# --------------------------------------------------------------------------
# Derived features
# --------------------------------------------------------------------------
def with_day7(df: DataFrame, average: str = S.DAY7, count: str | None = S.DAY7_COUNT) -> DataFrame:
    """Day-7 strength, specimen count, margin and ratio to the requirement."""
    return df.withColumns(
        {
            "Day7AverageStrength_psi": F.col(average).cast("double"),
            "Day7SpecimenCount": F.col(count).cast("double") if count else F.lit(None).cast("double"),
            "Day7MarginToRequired_psi": F.col(average) - F.col(S.REQUIRED),
            "Day7ToRequiredRatio": E.safe_div(average, S.REQUIRED),
        }
    )


def with_day7_compliance(df: DataFrame) -> DataFrame:
    """The second day-7 form: the ratio needs a positive requirement."""
    return df.withColumns(
        {
            "Strength7ToSpecifiedStrength28Ratio": F.when(
                F.col(S.REQUIRED) > 0, F.col(S.DAY7) / F.nullif(F.col(S.REQUIRED), F.lit(0.0))
            ),
            "Strength7Margin_psi": F.col(S.DAY7) - F.col(S.REQUIRED),
        }
    )


def valid_day7(df: DataFrame) -> DataFrame:
    """Rows with a positive day-7 strength, shared by all feature sets."""
    return df.where(F.col("Day7AverageStrength_psi") > 0)


def with_deviations(df: DataFrame) -> DataFrame:
    """Distance below and above the limits per measurement; out-of-spec count."""
    cols: dict[str, Column] = {}
    missing = F.lit(None).cast("double")
    for m in S.MEASUREMENTS:
        lo, hi = f"{m.raw}_specMin", f"{m.raw}_specMax"
        has = m.effective in df.columns
        cols[f"{m.label}BelowMinAmount"] = (
            E.below_amount(m.effective, lo) if has and lo in df.columns else missing
        )
        cols[f"{m.label}AboveMaxAmount"] = (
            E.below_amount(hi, m.effective) if has and hi in df.columns else missing
        )
    flags = present(df, S.OUT_OF_SPEC_FLAGS)
    out = missing
    if flags:
        count = sum((E.flag(F.col(c) == 1) for c in flags), F.lit(0)).cast("double")
        out = F.when(E.has_any(flags), count)
    return df.withColumns({**cols, "FieldOutOfSpecCount": out})


def with_recomputed_failure(df: DataFrame) -> DataFrame:
    """Failure flag from the definition, and whether the stored one differs."""
    computed = E.failure(S.TARGET, S.REQUIRED)
    return df.withColumns(
        {"FailureFlagMismatch": E.flag(E.known_true(F.col(S.FAILURE) != computed)), S.FAILURE: computed}
    )


def filter_trail(df: DataFrame, named: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each of the cumulative filters, in one pass."""
    kept = F.lit(True)
    counts = [F.count(F.lit(1)).alias("input_rows")]
    for name, condition in named:
        kept = kept & E.known_true(condition)
        counts.append(E.count_if(kept).alias(name))
    return df.agg(*counts)


def zero_fly_ash(df: DataFrame) -> DataFrame:
    """Missing fly ash means none where cement is known."""
    assume = F.col("CalcCementContent_lbs_yd3").isNotNull() & F.col("FlyAshContent_lbs_yd3").isNull()
    return df.withColumns(
        {
            "FlyAshAssumedZero": E.flag(assume),
            "FlyAshContent_lbs_yd3": F.when(assume, F.lit(0.0)).otherwise(F.col("FlyAshContent_lbs_yd3")),
        }
    )


def with_recipe_features(df: DataFrame) -> DataFrame:
    """Totals and shares of the recipe."""
    df = df.withColumns(
        {
            "TotalCementitiousContent_lbs_yd3": F.col("CalcCementContent_lbs_yd3") + F.col("FlyAshContent_lbs_yd3"),
            "TotalAggregateSSD_lbs_yd3": F.col("SandSSD_lbs_yd3") + F.col("AggregateSSD_lbs_yd3"),
        }
    )
    return df.withColumns(
        {
            "FlyAshFraction": E.safe_div("FlyAshContent_lbs_yd3", "TotalCementitiousContent_lbs_yd3"),
            "SandFractionOfAggregate": E.safe_div("SandSSD_lbs_yd3", "TotalAggregateSSD_lbs_yd3"),
        }
    )


def recipe_scope(df: DataFrame) -> DataFrame:
    """US tests with a valid cast date, missing fly ash taken as none where cement is known."""
    return zero_fly_ash(df).where(
        (F.col("ConcreteTestUnitSystem") == S.US_UNIT_SYSTEM) & (F.col("IsValidCastDate") == 1)
    )


def recipe_range_audit(df: DataFrame) -> DataFrame:
    """Values of each recipe column that the cohort sets to missing, out of the rows in scope."""
    audit = range_audit(recipe_scope(df), S.RECIPE_RANGES).where(F.col("PresentInInput") == 1)
    return audit.select(F.col("Column").alias("column"), F.col("ValuesSetToMissing").alias("invalid_replaced"))


def recipe_cohort(df: DataFrame) -> DataFrame:
    """Complete recipes of valid US tests with a strength, one row per test.

    Of a repeated test the complete row that sorts first over all columns stays.
    """
    ranged = with_recipe_features(null_outside(recipe_scope(df), S.RECIPE_RANGES))
    complete = ranged.dropna(how="any", subset=[*S.RECIPE_CORE, S.TARGET])
    return keep_first(complete, ["testId"], [F.col(c) for c in complete.columns])


def recipe_summary(df: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cohort size, share kept and distinct projects, suppliers, plants, mixes."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    out = cohort.agg(
        F.count(F.lit(1)).alias("batch_complete_strength_rows"),
        F.count_distinct("projectId").alias("projects"),
        F.count_distinct("SupplierName").alias("suppliers"),
        F.count_distinct("plantNumber").alias("plants"),
        F.count_distinct("mixNumber").alias("mixes"),
        F.coalesce(F.sum("FlyAshAssumedZero"), F.lit(0)).cast("long").alias("fly_ash_assumed_zero_rows"),
    ).withColumn("input_rows", total.scalar())
    return out.withColumn(
        "retained_percent", E.percent_even(F.col("batch_complete_strength_rows"), F.col("input_rows"))
    )


# --------------------------------------------------------------------------
# Row filters
# --------------------------------------------------------------------------
def mix_model_rows(df: DataFrame) -> DataFrame:
    """Rows fit for a mix strength model."""
    positive = [S.TARGET, "CalcCementContent_lbs_yd3", "SandSSD_lbs_yd3", "AggregateSSD_lbs_yd3", "calcWCRatio"]
    df = df.where(F.col("calcWCRatio").between(0.20, 0.90))
    if "AverageActualAgeDays" in df.columns:
        df = df.where(F.col("AverageActualAgeDays").between(25, 35))
    for c in positive:
        df = df.where(F.col(c) > 0)
    return df.dropna(how="any", subset=["FlyAshContent_lbs_yd3", "SandMoisture_percent", "AggregateMoisture_percent"])


def working_rows(df: DataFrame, subtype: int = S.ASTM_C39_SUBTYPE) -> DataFrame:
    """Specified tests of one subtype with a usable recipe."""
    nonzero = [
        "CalcCementContent_lbs_yd3",
        "AggregateSSD_lbs_yd3",
        "SandSSD_lbs_yd3",
        "AverageActualAgeDays",
        "calcWCRatio",
    ]
    df = df.where(~E.truthy("SpecifiedStrengthMissing") & (F.col("testSubTypeId") == subtype))
    for c in nonzero:
        df = df.where(F.col(c) != 0)
    return df.dropna(how="any", subset=["SandMoisture_percent", "FlyAshContent_lbs_yd3"])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def any_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def choose(df: DataFrame, column: str, values: object | Sequence[object] | None) -> DataFrame:
    """Keep rows whose text equals one of the values, ignoring case; None keeps all."""
    if values is None:
        return df
    if column not in df.columns:
        raise ValueError(f"column {column} is missing")
    wanted = [values] if isinstance(values, (str, int, float)) else list(values)
    text = F.lower(F.trim(F.col(column).cast("string")))
    return df.where(text.isin(*[str(v).strip().lower() for v in wanted]))


def within(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Optional closed limits; a missing value fails a set limit."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df


def until_year(df: DataFrame, year: int, date: str = "castDate") -> DataFrame:
    return df.where(F.year(date) <= year)


def between_years(df: DataFrame, first: int, last: int, date: str = "castDate") -> DataFrame:
    return df.where(F.year(date).between(first, last))


# --------------------------------------------------------------------------
# 28-day specimens
# --------------------------------------------------------------------------
def with_break_schedule(df: DataFrame) -> DataFrame:
    """Scheduled and actual break dates and how far they lie apart."""
    cast, tested = F.to_date("castDate"), F.to_date("testedOnDate")
    df = df.withColumns(
        {
            "ScheduledBreakDate": F.date_add(cast, F.col("daysToAge").cast("int")),
            "ActualBreakDate": tested,
            "ActualAgeDays": F.datediff(tested, cast),
        }
    )
    gap = F.datediff("ActualBreakDate", "ScheduledBreakDate")
    return df.withColumns(
        {
            "BreakDateDifferenceDays": gap,
            "TestedExactlyOnSchedule": E.known_true(gap == 0),
            "TestedWithinOneDayOfSchedule": E.known_true(gap.between(-1, 1)),
        }
    )


def curing_route(df: DataFrame, age: int = 28) -> DataFrame:
    """Route of each nominal-age specimen by its curing value."""
    cured = F.col("wasFieldCured")
    route = (
        F.when(cured == 0, F.lit("standard"))
        .when(cured == 1, F.lit("field"))
        .when(cured.isNull(), F.lit("unknown"))
        .otherwise(F.lit("unexpected"))
    )
    return df.where(F.col("daysToAge") == age).withColumn("CuringRoute", route)


def standard_specimens(routed: DataFrame) -> DataFrame:
    """Standard-cured specimens with a positive strength."""
    return routed.where((F.col("CuringRoute") == "standard") & (F.col("calcCompressiveStrength") > 0))


def specimen_issues(routed: DataFrame) -> DataFrame:
    """Review reasons of specimens: strength, break date and specification."""
    standard = F.col("CuringRoute") == "standard"
    valid = standard & E.known_true(F.col("calcCompressiveStrength") > 0)
    late = (
        F.col("ScheduledBreakDate").isNull()
        | F.col("ActualBreakDate").isNull()
        | ~F.col("TestedWithinOneDayOfSchedule")
    )
    routed = mark_duplicates(routed, "SpecimenRowId", "_duplicate")
    return (
        routed.withColumn(
            "SpecimenIssues",
            E.reasons(
                [
                    ("NullSpecimenId", F.col("SpecimenRowId").isNull()),
                    ("DuplicateSpecimenId", F.col("_duplicate") == 1),
                    ("InvalidStrength", standard & ~valid),
                    ("BreakDateIssue", valid & late),
                    ("SpecifiedAgeIssue", valid & E.known_true(F.col("SpecifiedBreakAge") != 28)),
                    ("MissingSpecification", valid & F.col("ApplicableSpecifiedStrength").isNull()),
                ]
            ),
        )
        .where(F.col("SpecimenIssues").isNotNull())
        .drop("_duplicate")
    )


def strength_target(standard: DataFrame) -> DataFrame:
    """Strength and age statistics per test of its standard-cured specimens.

    The first row of every specimen id is marked in a sort that spills; a distinct count beside the
    other statistics would keep a buffer of all of them per specimen.
    """
    s, age = "calcCompressiveStrength", "ActualAgeDays"
    same = Window.partitionBy("testId", "SpecimenRowId").orderBy("SpecimenRowId")
    first = F.col("SpecimenRowId").isNotNull() & (F.row_number().over(same) == 1)
    narrow = standard.select("testId", "SpecimenRowId", s, age).withColumn("_first", first)
    out = narrow.groupBy("testId").agg(
        F.count(F.lit(1)).alias("StandardCuredSpecimenCount28"),
        E.count_if(F.col("_first")).alias("UniqueStandardCuredSpecimenCount28"),
        F.avg(s).alias("AverageActualStrength28_psi"),
        F.min(s).alias("MinimumActualStrength28_psi"),
        F.max(s).alias("MaximumActualStrength28_psi"),
        F.stddev_samp(s).alias("ActualStrengthStdDev28_psi"),
        F.min(age).alias("MinimumActualAgeDays"),
        F.max(age).alias("MaximumActualAgeDays"),
        F.avg(age).alias("AverageActualAgeDays"),
    )
    return out.withColumns(
        {
            "ActualStrengthRange28_psi": F.col("MaximumActualStrength28_psi") - F.col("MinimumActualStrength28_psi"),
            "ActualStrengthCV28_percent": F.when(
                F.col("AverageActualStrength28_psi") > 0,
                F.col("ActualStrengthStdDev28_psi") / F.col("AverageActualStrength28_psi") * 100.0,
            ),
        }
    )


def specification_summary(standard: DataFrame) -> DataFrame:
    """First known specification values per test, in specimen id order."""
    firsts = [
        "SpecifiedBreakAge",
        "RequiredStrength",
        "DesignStrength",
        "ApplicableSpecifiedStrength",
        "ApplicableStrengthType",
    ]
    counts = ["RequiredStrengthRowCount", "DesignStrengthRowCount"]
    out = standard.groupBy("testId").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("SpecimenRowId"))).alias(c) for c in firsts],
        *[F.max(c).alias(c) for c in counts],
    )
    return out.withColumns(
        {
            "SpecifiedStrengthMissing": F.col("ApplicableSpecifiedStrength").isNull(),
            "SpecifiedBreakAgeIs28": E.known_true(F.col("SpecifiedBreakAge") == 28),
            "MultipleStrengthRowsFlag": F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in counts]) > 1,
        }
    )


def mixed_curing_rows(routed: DataFrame) -> DataFrame:
    """Specimens of tests that have more than one curing value."""
    mixed = (
        routed.groupBy("testId")
        .agg(F.min("wasFieldCured").alias("lo"), F.max("wasFieldCured").alias("hi"))
        .where(F.col("lo") < F.col("hi"))
    )
    return routed.join(mixed, "testId", "left_semi")


# Strength and ratio bands
STRENGTH_EDGES = [float("-inf"), 3000, 4000, 5000, 6000, float("inf")]
STRENGTH_LABELS = ["< 3000 psi", "3000-3999 psi", "4000-4999 psi", "5000-5999 psi", ">= 6000 psi"]
RATIO_EDGES = [0.00, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.70, 1.00]
ERROR_EDGES = [0, 3000, 4000, 5000, 6000, 7000, 9000, float("inf")]


def interval_labels(edges: Sequence[float], right: bool) -> list[str]:
    """Interval text such as ``[0.3, 0.35)`` or ``(0, 3000]``."""
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        a, b = f"{float(lo)}", f"{float(hi)}"
        out.append(f"({a}, {b}]" if right else f"[{a}, {b})")
    return out


def with_bands(df: DataFrame) -> DataFrame:
    """Strength band and water-cement band, closed on the left."""
    return df.withColumns(
        {
            "StrengthBand": E.band(S.TARGET, STRENGTH_EDGES, STRENGTH_LABELS),
            "WCMRange": E.band("calcWCRatio", RATIO_EDGES, interval_labels(RATIO_EDGES, False)),
            "ErrorRange": E.band(S.TARGET, ERROR_EDGES, interval_labels(ERROR_EDGES, True), right=True),
        }
    )


# --------------------------------------------------------------------------
# Column sets
# --------------------------------------------------------------------------
def drop_listed(df: DataFrame, columns: Sequence[str] = tuple(S.WORKING_SET_DROPS)) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns to drop are missing: {missing}")
    return df.drop(*columns)


def assert_no_collisions(df: DataFrame) -> DataFrame:
    """Fail at plan time when a join left two columns of one name or a suffix pair."""
    lowered = [c.lower() for c in df.columns]
    repeated = sorted({c for c in lowered if lowered.count(c) > 1})
    suffixed = [c for c in df.columns if c.endswith(("_x", "_y"))]
    if repeated or suffixed:
        raise ValueError(f"duplicate columns after join: {repeated + suffixed}")
    return df


def feature_columns(df: DataFrame, feature_set: str, sets: Mapping[str, Sequence[str]] = S.FEATURE_SETS) -> list[str]:
    """Available columns of a named feature set, refusing any leakage column."""
    leaks = sorted(set(sets[feature_set]) & set(S.LEAKAGE_COLUMNS))
    if leaks:
        raise ValueError(f"{feature_set} contains leakage columns: {leaks}")
    found = [c for c in sets[feature_set] if c in df.columns]
    if not found:
        raise ValueError(f"{feature_set} has no column in this data")
    return found


def feature_frame(df: DataFrame, feature_set: str, keep: Sequence[str] = ("testId",)) -> DataFrame:
    names = feature_columns(df, feature_set)
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in names])
