"""Source tables to one row per concrete test.

Detail tables are aggregated to test grain before they are joined, so no join fans
out. All large joins use the concrete test key, which lets Spark reuse one hash
partitioning from the aggregations through to the final join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E


@dataclass(frozen=True)
class ExtractOptions:
    """Parameters of the extract. ``last_valid_day`` replaces "today"."""

    last_valid_day: str
    first_valid_day: str = S.MIN_VALID_CAST_DATE
    unit_system: int = S.US_UNIT_SYSTEM
    office_id: int | None = None
    excluded_offices: Sequence[int] = field(default_factory=lambda: list(S.EXCLUDED_OFFICES))
    first_cast_day: str | None = None
    last_cast_day: str | None = None

    @property
    def narrow(self) -> bool:
        """Whether the scope is one office or a stretch of cast days, a small part of all tests."""
        return self.office_id is not None or self.first_cast_day is not None or self.last_cast_day is not None


# --------------------------------------------------------------------------
# Batch rows
# --------------------------------------------------------------------------
def classify_batch_rows(batch: DataFrame) -> DataFrame:
    """Used batch rows with material group, SSD weight and water weight."""
    name = F.upper(F.trim("name"))
    group = (
        F.when(name.isin(*S.SAND_NAMES), F.lit("SAND"))
        .when(name.isin(*S.AGGREGATE_NAMES), F.lit("AGGREGATE"))
        .otherwise(F.lit("OTHER"))
    )
    valid = F.coalesce(F.col("moisture") > -100, F.lit(False))
    ssd = F.when(valid, F.col("weight") / F.nullif(F.lit(1.0) + F.col("moisture") / 100.0, F.lit(0.0)))
    return batch.where(F.col("weight") > 0).select(
        "concreteTestId",
        group.alias("MaterialGroup"),
        F.col("weight").alias("BatchWeight_lbs"),
        F.col("moisture").alias("Moisture_percent"),
        ssd.alias("SSDWeight_lbs"),
        (F.col("weight") - ssd).alias("WaterWeight_lbs"),
        E.flag(~valid).alias("HasInvalidMoisture"),
    )


def roll_up_batch(rows: DataFrame) -> DataFrame:
    """Weights, moisture and component counts of sand and aggregate per test."""
    out: list[Column] = []
    for group, label in (("SAND", "Sand"), ("AGGREGATE", "Aggregate")):
        here = F.col("MaterialGroup") == group

        def total(c: str) -> Column:
            return F.sum(F.when(here, F.col(c)).otherwise(F.lit(0.0)))

        water, ssd = total("WaterWeight_lbs"), total("SSDWeight_lbs")
        bad = F.max(F.when(here, F.col("HasInvalidMoisture")).otherwise(F.lit(0)))
        out += [
            total("BatchWeight_lbs").alias(f"{label}BatchWeight_lbs"),
            ssd.alias(f"{label}SSDWeight_lbs"),
            water.alias(f"{label}WaterWeight_lbs"),
            F.when(bad != 1, water / F.nullif(ssd, F.lit(0.0)) * 100.0).alias(f"{label}Moisture_percent"),
            E.count_if(here).alias(f"{label}ComponentCount"),
        ]
    return (
        rows.where(F.col("MaterialGroup").isin("SAND", "AGGREGATE"))
        .groupBy("concreteTestId")
        .agg(*out)
    )


# --------------------------------------------------------------------------
# Strength requirements and specimens
# --------------------------------------------------------------------------
def strength_by_age(rows: DataFrame) -> DataFrame:
    """Largest required and design strength per test and break age."""
    kind = F.col("strengthType")
    required, design = kind == S.REQUIRED_STRENGTH_TYPE, kind == S.DESIGN_STRENGTH_TYPE
    return (
        rows.where(
            F.col("days").isNotNull()
            & F.col("strength").isNotNull()
            & kind.isin(S.REQUIRED_STRENGTH_TYPE, S.DESIGN_STRENGTH_TYPE)
        )
        .groupBy("concreteTestId", F.col("days").alias("BreakAge"))
        .agg(
            F.max(F.when(required, F.col("strength"))).alias("RequiredStrength"),
            F.max(F.when(design, F.col("strength"))).alias("DesignStrength"),
            E.count_if(required).alias("RequiredStrengthRowCount"),
            E.count_if(design).alias("DesignStrengthRowCount"),
        )
    )


def applicable(df: DataFrame) -> DataFrame:
    """Required strength where present, else design strength, with its type."""
    return df.withColumns(
        {
            "ApplicableSpecifiedStrength": F.coalesce("RequiredStrength", "DesignStrength"),
            "ApplicableStrengthType": F.when(
                F.col("RequiredStrength").isNotNull(), F.lit("Required")
            ).when(F.col("DesignStrength").isNotNull(), F.lit("Design")),
        }
    )


def requirement_at_28(by_age: DataFrame) -> DataFrame:
    """The 28-day requirement of each test."""
    at28 = applicable(by_age.where(F.col("BreakAge") == 28))
    return at28.select(
        "concreteTestId",
        F.col("BreakAge").alias("SpecifiedBreakAge"),
        F.col("RequiredStrength").alias("RequiredStrength28"),
        F.col("DesignStrength").alias("DesignStrength28"),
        F.col("ApplicableSpecifiedStrength").alias(S.REQUIRED),
        F.col("ApplicableStrengthType").alias("ApplicableStrengthType28"),
        F.col("RequiredStrengthRowCount").alias("RequiredStrength28RowCount"),
        F.col("DesignStrengthRowCount").alias("DesignStrength28RowCount"),
    )


def summarize_specimens(specimens: DataFrame, requirement: DataFrame) -> DataFrame:
    """Strength statistics per test, split by age and curing."""
    joined = specimens.withColumn(
        "_strength", F.coalesce("calcCompressiveStrengthUnrounded", "calcCompressiveStrength")
    ).join(requirement.select("concreteTestId", S.REQUIRED), "concreteTestId", "left")
    strength, spec = F.col("_strength"), F.col(S.REQUIRED)
    tested = strength.isNotNull()

    def at(age: int, cured: int) -> Column:
        return (F.col("daysToAge") == age) & (F.col("wasFieldCured") == cured)

    out = [
        F.count(F.lit(1)).alias("TotalSpecimenRowCount"),
        E.count_if(tested).alias("TotalTestedSpecimenCount"),
    ]
    for age in (7, 28):
        standard = F.when(at(age, 0), strength)
        out += [
            F.avg(standard).alias(f"AverageActualStrength{age}_psi"),
            F.min(standard).alias(f"MinimumActualStrength{age}_psi"),
            F.max(standard).alias(f"MaximumActualStrength{age}_psi"),
            F.count(standard).alias(f"ActualStrength{age}SpecimenCount"),
            E.count_if(at(age, 1) & tested).alias(f"FieldCuredStrength{age}SpecimenCount"),
        ]
    cured28 = at(28, 0)
    out += [
        E.count_if(cured28 & (strength < spec)).alias("BelowSpecifiedStrength28SpecimenCount"),
        E.count_if(cured28 & (strength >= spec)).alias("AtOrAboveSpecifiedStrength28SpecimenCount"),
        E.count_if(cured28 & tested & spec.isNull()).alias("UnevaluableStrength28SpecimenCount"),
    ]
    return joined.groupBy("concreteTestId").agg(*out)


# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------
def join_entities(t: Mapping[str, DataFrame]) -> DataFrame:
    """Office, project, sample, test and concrete test in one row.

    Tests find their office in narrow rows; the wide concrete tests take part in one join only.
    """
    offices = t["offices"].withColumnRenamed("name", "OfficeName")
    samples = t["samples"].withColumnRenamed("id", "SampleId")
    tests = t["tests"].select("testId", F.col("sampleId").alias("SampleId"))
    concrete = t["concrete_tests"].withColumnsRenamed({"id": "ConcreteTestDataId", "testbaseId": "testId"})
    chain = tests.join(samples, "SampleId").join(t["projects"], "projectId").join(offices, "officeId")
    keys = ["officeId", "projectId", "SampleId", "testId"]
    measured, named = ([c for c in side.columns if c not in keys] for side in (concrete, chain))
    return concrete.join(chain, "testId").select(*keys, *measured, *named)


def join_lookups(df: DataFrame, lookup: DataFrame, outputs: Mapping[str, str], locale: int = 0) -> DataFrame:
    """One left join per resource id column; Spark picks broadcast by table size."""
    names = lookup.where(F.col("localeId") == locale).select("resourceId", "value")
    for source, target in outputs.items():
        side = names.select(F.col("resourceId").alias(f"_{source}"), F.col("value").alias(target))
        df = df.join(side, F.col(source) == F.col(f"_{source}"), "left").drop(f"_{source}")
    return df


def join_supplier(df: DataFrame, suppliers: DataFrame) -> DataFrame:
    side = suppliers.select(F.col("id").alias("supplierId"), F.col("name").alias("SupplierName"))
    return df.join(side, "supplierId", "left")


def exclude_keys(df: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the exclusion list."""
    return df.join(exclusions.select(key).distinct(), key, "left_anti")


def scope_filter(df: DataFrame, o: ExtractOptions) -> DataFrame:
    """Unit system, office and cast-date window; unset parameters add no filter."""
    df = df.where(F.col("unitSystem") == o.unit_system)
    if o.office_id is not None:
        df = df.where(F.col("officeId") == o.office_id)
    if o.excluded_offices:
        df = df.where(~F.col("officeId").isin(*o.excluded_offices))
    if o.first_cast_day is not None:
        df = df.where(F.col("castDate") >= F.lit(o.first_cast_day).cast("date"))
    if o.last_cast_day is not None:
        df = df.where(F.col("castDate") < F.date_add(F.lit(o.last_cast_day).cast("date"), 1))
    return df


# --------------------------------------------------------------------------
# Derived columns
# --------------------------------------------------------------------------
def with_effective_measurements(df: DataFrame) -> DataFrame:
    """Effective value, its source and the After-SP flag of each measurement."""
    cols: dict[str, Column] = {}
    for m in S.MEASUREMENTS:
        cols[m.effective] = E.effective_value(m)
        cols[f"{m.label}MeasurementSource"] = E.effective_source(m)
        cols[f"HasAfterSP{m.label}"] = E.flag(E.usable(f"{m.raw}_afterSP", f"{m.raw}_afterSPNA"))
    df = df.withColumns(cols)
    return df.withColumns(
        {
            **{
                f"Effective{m.label}Missing": E.flag(F.col(m.effective).isNull())
                for m in S.MEASUREMENTS
            },
            "HasAnyAfterSPMeasurement": F.greatest(*[F.col(f"HasAfterSP{m.label}") for m in S.MEASUREMENTS]),
            "HasAnyEffectiveFreshConcreteMeasurement": E.flag(E.has_any(S.FRESH_COLUMNS)),
        }
    )


def with_compliance(df: DataFrame) -> DataFrame:
    """Out-of-spec flag per measurement and over all measurements."""
    df = df.withColumns({f"{m.label}OutOfSpecFlag": E.out_of_spec(m) for m in S.MEASUREMENTS})
    flags = [F.col(c) for c in S.OUT_OF_SPEC_FLAGS]
    return df.withColumns(
        {
            "HasAnyFieldMeasurementWithSpec": E.flag(E.has_any(flags)),
            "HasAnyFieldMeasurementOutOfSpec": E.any_out_of_spec(flags),
        }
    )


def with_water(df: DataFrame) -> DataFrame:
    """Added water in gallons and per cubic yard of the current load."""
    df = df.withColumns(
        {
            "WaterAdded_gallons": E.unless_na("waterAdded", "waterAddedNA"),
            "LoadBatchVolume_yd3": E.unless_na("batchSize", "LoadBatchVolumneNA"),
        }
    )
    gallons, volume = F.col("WaterAdded_gallons"), F.col("LoadBatchVolume_yd3")
    return df.withColumns(
        {
            "WaterAdded_gal_per_yd3": F.when(volume > 0, gallons / F.nullif(volume, F.lit(0.0))),
            "WaterAdded_lb_per_yd3": F.when(
                volume > 0, gallons * F.lit(S.POUNDS_PER_GALLON) / F.nullif(volume, F.lit(0.0))
            ),
            "HasWaterAdded": (gallons > 0).cast("int"),
        }
    ).withColumn("WaterAddedPerVolumeMissing", E.flag(F.col("WaterAdded_gal_per_yd3").isNull()))


def with_times_and_text(df: DataFrame, o: ExtractOptions) -> DataFrame:
    """Valid-date flag, elapsed minutes, ambient temperature and curing text."""
    curing = E.clean_text("initialCuringCondition")
    return df.withColumns(
        {
            "IsValidCastDate": E.flag(E.valid_day("castDate", o.first_valid_day, o.last_valid_day)),
            "BatchToSampleMinutes": E.elapsed_minutes("batchTime", "sampleTime"),
            "BatchToCastMinutes": E.elapsed_minutes("batchTime", "finishTime"),
            "AmbientTemp_F": E.unless_na("ambientTemp", "ambientTempNA"),
            "InitialCuringConditionRaw": curing,
            "InitialCuringConditionClean": F.lower(curing),
            "InitialCuringConditionMissing": E.flag(curing.isNull()),
        }
    )


def with_targets(df: DataFrame) -> DataFrame:
    """Margins, failure flags, ranges and shares of the strength results."""
    actual, required, day7 = F.col(S.TARGET), F.col(S.REQUIRED), F.col(S.DAY7)
    below = F.col("BelowSpecifiedStrength28SpecimenCount")
    above = F.col("AtOrAboveSpecifiedStrength28SpecimenCount")
    field_out = F.col("HasAnyFieldMeasurementOutOfSpec")
    return df.withColumns(
        {
            "SpecifiedStrengthMissing": E.flag(required.isNull()),
            **{
                f"ActualStrengthRange{age}_psi": F.col(f"MaximumActualStrength{age}_psi")
                - F.col(f"MinimumActualStrength{age}_psi")
                for age in (7, 28)
            },
            "HasAnyBelowSpecifiedStrength28Specimen": F.when(
                F.col("ActualStrength28SpecimenCount") > 0, E.flag(below > 0)
            ),
            "BelowSpecifiedStrength28SpecimenPercent": E.percent2(below, below + above),
            "StrengthMargin28_psi": actual - required,
            S.FAILURE: E.failure(actual, required),
            "FieldOutOfSpecAndStrengthFailure28": F.when(
                field_out.isNotNull() & (actual - required).isNotNull(),
                E.flag((field_out == 1) & (actual < required)),
            ),
            "ActualStrength7To28Ratio": E.safe_div(day7, actual),
        }
    )


def with_recipe(df: DataFrame) -> DataFrame:
    """Batch quantities per cubic yard and the fly-ash share."""
    cement, ash, yld = F.col("cementQuantity"), F.col("flyAshQuantity"), F.col("calcYield")
    ash0 = F.coalesce(ash, F.lit(0.0))
    return df.withColumns(
        {
            "SandSSD_lbs_yd3": E.safe_div("SandSSDWeight_lbs", yld),
            "AggregateSSD_lbs_yd3": E.safe_div("AggregateSSDWeight_lbs", yld),
            "FlyAshContent_lbs_yd3": E.safe_div(ash, yld),
            "TotalCementitiousContent_lbs_yd3": E.safe_div(cement + ash0, yld),
            "FlyAshFraction": E.safe_div(ash0, cement + ash0),
        }
    )


def with_candidate_flags(df: DataFrame) -> DataFrame:
    """Which rows can serve the two field models, and which carry batch data."""
    candidate = (
        F.col(S.TARGET).isNotNull()
        & (F.col("HasAnyEffectiveFreshConcreteMeasurement") == 1)
        & (F.col("IsValidCastDate") == 1)
    )
    batch_rows = F.col("SandComponentCount").isNotNull()
    return df.withColumns(
        {
            "HasSandOrAggregateBatchRows": E.flag(batch_rows),
            "HasAnyBatchData": E.flag(
                batch_rows | E.has_any(["cementQuantity", "flyAshQuantity", "waterQuantity", "calcWCRatio"])
            ),
            "IsFieldCoreStrengthCandidate": E.flag(candidate),
            "IsFieldCoreWithRequiredStrengthCandidate": E.flag(candidate & F.col(S.REQUIRED).isNotNull()),
        }
    )


LOOKUP_OUTPUTS = {
    "resWaterUnits": "WaterUnits",
    "resCloudType": "CloudType",
    "resPrecipitationType": "PrecipitationType",
    "resWindType": "WindType",
    "resFinalCure": "FinalCure_AuditOnly",
}
RENAMES = {
    "unitSystem": "ConcreteTestUnitSystem",
    "finishTime": "castTime",
    "batchSize": "LoadBatchVolumeRaw",
    "LoadBatchVolumneNA": "LoadBatchVolumeNA",
    "waterAdded": "WaterAddedRaw",
    "ambientTemp": "AmbientTempRaw",
    "cementQuantity": "CementQuantity_lbs",
    "flyAshQuantity": "FlyAshQuantity_lbs",
    "calcYield": "CalcYield_yd3",
    "calcCementContent": "CalcCementContent_lbs_yd3",
}


def build_extract(t: Mapping[str, DataFrame], o: ExtractOptions) -> DataFrame:
    """One row per concrete test in scope, with every derived column."""
    scoped = scope_filter(join_entities(t), o)
    rows = {name: t[name] for name in ("batch_rows", "strength_rows", "specimen_rows")}
    if o.narrow:
        # Details of tests outside the scope are dropped before they are rolled up.
        keys = scoped.select(F.col("ConcreteTestDataId").alias("concreteTestId")).distinct()
        rows = {name: detail.join(keys, "concreteTestId", "left_semi") for name, detail in rows.items()}
    requirement = requirement_at_28(strength_by_age(rows["strength_rows"]))
    details = [
        roll_up_batch(classify_batch_rows(rows["batch_rows"])),
        requirement,
        summarize_specimens(rows["specimen_rows"], requirement),
    ]
    # The three joins below need this partitioning; asking for it once also spreads the
    # wide projections when a small detail table turns a join into a broadcast.
    df = scoped.withColumn("concreteTestId", F.col("ConcreteTestDataId")).repartition("concreteTestId")
    for side in details:
        df = df.join(side, "concreteTestId", "left")
    df = join_supplier(df.drop("concreteTestId"), t["suppliers"])
    df = join_lookups(df, t["lookup"], LOOKUP_OUTPUTS).drop(*LOOKUP_OUTPUTS)
    df = with_times_and_text(df, o)
    for step in (
        with_effective_measurements,
        with_compliance,
        with_water,
        with_targets,
        with_recipe,
        with_candidate_flags,
    ):
        df = step(df)
    return df.drop("initialCuringCondition").withColumnsRenamed(RENAMES)


def model_rows(
    extract: DataFrame,
    include_invalid_dates: bool = False,
    require_actual: bool = True,
    require_measurement: bool = True,
) -> DataFrame:
    """Switchable output filter of the extract."""
    if not include_invalid_dates:
        extract = extract.where(F.col("IsValidCastDate") == 1)
    if require_actual:
        extract = extract.where(F.col(S.TARGET).isNotNull())
    if require_measurement:
        extract = extract.where(F.col("HasAnyEffectiveFreshConcreteMeasurement") == 1)
    return extract


# --------------------------------------------------------------------------
# Specimen grain
# --------------------------------------------------------------------------
def specimen_extract(t: Mapping[str, DataFrame], office_id: int | None = None) -> DataFrame:
    """One row per tested specimen with the requirement at its own break age."""
    entities = join_entities(t)
    if office_id is not None:
        entities = entities.where(F.col("officeId") == office_id)
    batch = roll_up_batch(classify_batch_rows(t["batch_rows"]))
    ages = strength_by_age(t["strength_rows"]).withColumn("daysToAge", F.col("BreakAge"))
    specimens = t["specimen_rows"].where(F.col("calcCompressiveStrength").isNotNull())
    with_requirement = specimens.join(ages, ["concreteTestId", "daysToAge"], "left")
    df = (
        entities.withColumn("concreteTestId", F.col("ConcreteTestDataId"))
        .join(batch, "concreteTestId")
        .join(with_requirement, "concreteTestId")
    )
    df = join_supplier(df, t["suppliers"])
    df = join_lookups(df, t["lookup"], LOOKUP_OUTPUTS).drop(*LOOKUP_OUTPUTS)
    df = applicable(with_recipe(df))
    return df.withColumnRenamed("id", "SpecimenRowId").withColumnRenamed("BreakAge", "SpecifiedBreakAge")


def specimen_data_summary(specimens: DataFrame) -> DataFrame:
    """Row and distinct counts of the specimen set with its date span."""
    distinct = {
        "UniqueSpecimenCount": "SpecimenRowId",
        "ConcreteTestCount": "testId",
        "SampleCount": "labNo",
        "ProjectCount": "projectNo",
        "SupplierCount": "SupplierName",
    }
    return specimens.agg(
        F.count(F.lit(1)).alias("SpecimenCount"),
        *[F.count_distinct(c).alias(n) for n, c in distinct.items()],
        F.min("castDate").alias("EarliestCastDate"),
        F.max("castDate").alias("LatestCastDate"),
    )


def strength_by_break_age(specimens: DataFrame) -> DataFrame:
    return specimens.groupBy(F.col("daysToAge").alias("DaysToAge")).agg(
        F.count(F.lit(1)).alias("SpecimenCount"),
        F.count_distinct("testId").alias("ConcreteTestCount"),
        F.avg("calcCompressiveStrength").alias("AverageStrength"),
    )


def target_28_by_test(specimens: DataFrame) -> DataFrame:
    """28-day strength statistics per test with the sample deviation."""
    s = "calcCompressiveStrength"
    return (
        specimens.where((F.col("daysToAge") == 28) & F.col(s).isNotNull())
        .groupBy("testId")
        .agg(
            F.count(F.lit(1)).alias("SpecimenCount28"),
            F.avg(s).alias("AverageStrength28"),
            F.min(s).alias("MinimumStrength28"),
            F.max(s).alias("MaximumStrength28"),
            F.stddev_samp(s).alias("StrengthStandardDeviation28"),
        )
    )


# --------------------------------------------------------------------------
# Coverage
# --------------------------------------------------------------------------
def coverage_summary(extract: DataFrame) -> DataFrame:
    """Counts, shares and date span of the extract in one row."""
    c = F.col

    def present(name: str) -> Column:
        return c(name).isNotNull()

    rows = F.count(F.lit(1))
    below, above = (
        F.sum("BelowSpecifiedStrength28SpecimenCount"),
        F.sum("AtOrAboveSpecifiedStrength28SpecimenCount"),
    )
    out_of_spec, failed = c("HasAnyFieldMeasurementOutOfSpec"), c(S.FAILURE) == 1

    def below_where(state: int) -> Column:
        return F.sum(
            F.when(out_of_spec == state, c("BelowSpecifiedStrength28SpecimenCount")).otherwise(F.lit(0))
        )

    counts = {
        "TestsWithValidCastDate": c("IsValidCastDate") == 1,
        "TestsWithInvalidOrMissingCastDate": c("IsValidCastDate") == 0,
        "TestsWithRequiredStrength28": present("RequiredStrength28"),
        "TestsWithApplicableSpecifiedStrength28": present(S.REQUIRED),
        "TestsWithActualStrength7": present(S.DAY7),
        "TestsWithActualStrength28": present(S.TARGET),
        "FailedStrengthTestCount28": failed,
        "TestsWithAnyBelowSpecifiedStrength28Specimen": c("BelowSpecifiedStrength28SpecimenCount") > 0,
        "TestsWithAnyEvaluableFieldSpecification": c("HasAnyFieldMeasurementWithSpec") == 1,
        "FieldOutOfSpecTestCount": out_of_spec == 1,
        "FieldOutOfSpecAndStrengthFailure28Count": (out_of_spec == 1) & failed,
        "FieldWithinSpecButStrengthFailure28Count": (out_of_spec == 0) & failed,
        "TestsWithEffectiveSlump": present("EffectiveSlump_in"),
        "TestsWithEffectiveSpread": present("EffectiveSpread_in"),
        "TestsWithEffectiveAir": present("EffectiveAir_percent"),
        "TestsWithEffectiveUnitWeight": present("EffectiveUnitWeight_lb_ft3"),
        "TestsWithEffectiveConcreteTemperature": present("EffectiveConcreteTemp_F"),
        "TestsWithAmbientTemperature": present("AmbientTemp_F"),
        "TestsWithNormalizedWaterAdded": present("WaterAdded_gal_per_yd3"),
        "TestsWithAnyAfterSPMeasurement": c("HasAnyAfterSPMeasurement") == 1,
        "TestsWithInitialCuringConditionText": c("InitialCuringConditionMissing") == 0,
        "TestsWithAnyEffectiveFreshMeasurement": c("HasAnyEffectiveFreshConcreteMeasurement") == 1,
        "FieldCoreStrengthCandidateCount": c("IsFieldCoreStrengthCandidate") == 1,
        "FieldCoreWithRequiredStrengthCandidateCount": c("IsFieldCoreWithRequiredStrengthCandidate") == 1,
        "TestsWithAnyBatchData": c("HasAnyBatchData") == 1,
    }
    shares = {
        "ActualStrength28CoveragePercent": "TestsWithActualStrength28",
        "EffectiveFreshMeasurementCoveragePercent": "TestsWithAnyEffectiveFreshMeasurement",
        "NormalizedWaterAddedCoveragePercent": "TestsWithNormalizedWaterAdded",
        "FieldCoreStrengthCandidatePercent": "FieldCoreStrengthCandidateCount",
        "BatchDataCoveragePercent": "TestsWithAnyBatchData",
    }
    valid_day = F.when(c("IsValidCastDate") == 1, c("castDate"))
    return extract.agg(
        rows.alias("ConcreteTestCount"),
        *[
            F.count_distinct(k).alias(n)
            for n, k in (
                ("OfficeCount", "officeId"),
                ("ProjectCount", "projectId"),
                ("SampleCount", "SampleId"),
                ("SupplierCount", "SupplierName"),
            )
        ],
        F.min("ConcreteTestUnitSystem").alias("ConcreteTestUnitSystem"),
        *[E.count_if(cond).alias(n) for n, cond in counts.items()],
        F.sum("TotalSpecimenRowCount").alias("TotalSpecimenRowCount"),
        F.sum("TotalTestedSpecimenCount").alias("TotalTestedSpecimenCount"),
        F.sum("ActualStrength28SpecimenCount").alias("TotalStrength28SpecimenCount"),
        below.alias("TotalBelowSpecifiedStrength28SpecimenCount"),
        above.alias("TotalAtOrAboveSpecifiedStrength28SpecimenCount"),
        F.sum("UnevaluableStrength28SpecimenCount").alias("TotalUnevaluableStrength28SpecimenCount"),
        E.percent2(below, below + above).alias("OverallBelowSpecifiedStrength28SpecimenPercent"),
        below_where(1).alias("BelowSpec28SpecimensFromFieldOutOfSpecTests"),
        below_where(0).alias("BelowSpec28SpecimensFromFieldWithinSpecTests"),
        E.percent2(
            E.count_if((out_of_spec == 1) & failed),
            E.count_if((out_of_spec == 1) & present(S.FAILURE)),
        ).alias("StrengthFailureRateAmongFieldOutOfSpecPercent"),
        *[E.percent2(E.count_if(counts[src]), rows).alias(n) for n, src in shares.items()],
        F.min(valid_day).alias("EarliestValidCastDate"),
        F.max(valid_day).alias("LatestValidCastDate"),
        F.min("castDate").alias("RawEarliestCastDate"),
        F.max("castDate").alias("RawLatestCastDate"),
    )


def specimens_per_test(extract: DataFrame) -> DataFrame:
    """How many tests have 0, 1, 2, ... standard-cured 28-day specimens."""
    below = F.coalesce("BelowSpecifiedStrength28SpecimenCount", F.lit(0))
    return extract.groupBy(
        F.coalesce("ActualStrength28SpecimenCount", F.lit(0)).alias("Strength28SpecimensPerConcreteTest")
    ).agg(
        F.count(F.lit(1)).alias("ConcreteTestCount"),
        F.sum(below).alias("BelowSpecifiedStrength28SpecimenCount"),
        F.sum(F.coalesce("AtOrAboveSpecifiedStrength28SpecimenCount", F.lit(0))).alias(
            "AtOrAboveSpecifiedStrength28SpecimenCount"
        ),
        E.count_if(below > 0).alias("TestsWithAnyBelowSpecifiedStrength28Specimen"),
    )


def slump_check(df: DataFrame) -> DataFrame:
    """Text 'True'/'False'/NULL check of slump against both limits."""
    slump, low, high = F.col("EffectiveSlump_in"), F.col("uwSlump_specMin"), F.col("uwSlump_specMax")
    known = slump.isNotNull() & low.isNotNull() & high.isNotNull()
    outside = (slump < low) | (slump > high)
    return df.withColumn(
        "OutOfSlumpSpec", F.when(known, F.when(outside, F.lit("True")).otherwise(F.lit("False")))
    )
