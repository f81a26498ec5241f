"""Column names, ranges, feature sets and texts used across the package.

Everything in this module is a fixed value: a name, list, limit or text that has
to be equal to the established data contract for results to be right.
"""

from __future__ import annotations

from typing import NamedTuple

# --------------------------------------------------------------------------
# Extract parameters
# --------------------------------------------------------------------------
REQUIRED_STRENGTH_TYPE = 30010
DESIGN_STRENGTH_TYPE = 30011
US_UNIT_SYSTEM = 0
EXCLUDED_OFFICES = [1, 26, 64]
MIN_VALID_CAST_DATE = "2000-01-01"
POUNDS_PER_GALLON = 8.34
MINUTES_PER_DAY = 1440
ASTM_C39_SUBTYPE = 30050

SAND_NAMES = ["MISC SAND 1", "MISC SAND 2"]
AGGREGATE_NAMES = ["MISC AGGREGATE 1", "MISC AGGREGATE 2", "MISC AGGREGATE 3"]


class Measurement(NamedTuple):
    """One fresh-concrete measurement: raw column prefix and output names."""

    raw: str
    label: str
    effective: str


# The five fresh-concrete measurements
MEASUREMENTS = [
    Measurement("uwSlump", "Slump", "EffectiveSlump_in"),
    Measurement("uwSpread", "Spread", "EffectiveSpread_in"),
    Measurement("uwAir", "Air", "EffectiveAir_percent"),
    Measurement("uwWeight", "UnitWeight", "EffectiveUnitWeight_lb_ft3"),
    Measurement("uwConcreteTemp", "ConcreteTemp", "EffectiveConcreteTemp_F"),
]
FRESH_COLUMNS = [m.effective for m in MEASUREMENTS]
OUT_OF_SPEC_FLAGS = [f"{m.label}OutOfSpecFlag" for m in MEASUREMENTS]

TARGET = "AverageActualStrength28_psi"
REQUIRED = "ApplicableSpecifiedStrength28"
DAY7 = "AverageActualStrength7_psi"
DAY7_COUNT = "ActualStrength7SpecimenCount"
FAILURE = "FailureFlag28"

# --------------------------------------------------------------------------
# Cleaning limits
# --------------------------------------------------------------------------
CORE_FRESH = [
    "EffectiveSlump_in",
    "EffectiveAir_percent",
    "EffectiveUnitWeight_lb_ft3",
    "EffectiveConcreteTemp_F",
]
CLEAN_RANGES = {
    "EffectiveSlump_in": (0.0, 30.0),
    "EffectiveAir_percent": (0.0, 20.0),
    "EffectiveUnitWeight_lb_ft3": (40.0, 220.0),
    "EffectiveConcreteTemp_F": (-20.0, 160.0),
    "AmbientTemp_F": (-80.0, 160.0),
    "WaterAdded_gal_per_yd3": (0.0, 20.0),
    "BatchToSampleMinutes": (0.0, 720.0),
    "BatchToCastMinutes": (0.0, 720.0),
    "EffectiveSpread_in": (0.0, 40.0),
}
INDICATORS = ["HasWaterAdded", "HasAnyAfterSPMeasurement"]
MAX_STRENGTH_PSI = 20000.0
LOW_STRENGTH_REVIEW_PSI = 1000.0

MODEL_RANGES = {
    "ApplicableSpecifiedStrength28": (500.0, 20000.0),
    "AverageActualStrength7_psi": (100.0, 30000.0),
    "AverageActualStrength28_psi": (100.0, 30000.0),
    "EffectiveSlump_in": (0.0, 20.0),
    "EffectiveSpread_in": (0.0, 60.0),
    "EffectiveAir_percent": (0.0, 20.0),
    "EffectiveUnitWeight_lb_ft3": (50.0, 200.0),
    "EffectiveConcreteTemp_F": (20.0, 130.0),
    "AmbientTemp_F": (-40.0, 140.0),
    "WaterAdded_gal_per_yd3": (0.0, 100.0),
    "BatchToSampleMinutes": (0.0, 1440.0),
    "BatchToCastMinutes": (0.0, 1440.0),
}
RECIPE_RANGES = {
    "CalcCementContent_lbs_yd3": (100.0, 1500.0),
    "FlyAshContent_lbs_yd3": (0.0, 800.0),
    "TotalCementitiousContent_lbs_yd3": (100.0, 1800.0),
    "FlyAshFraction": (0.0, 0.90),
    "calcWCRatio": (0.15, 1.00),
    "SandSSD_lbs_yd3": (100.0, 5000.0),
    "AggregateSSD_lbs_yd3": (100.0, 6000.0),
    "SandMoisture_percent": (-10.0, 30.0),
    "AggregateMoisture_percent": (-10.0, 30.0),
    "WaterAdded_gal_per_yd3": (0.0, 100.0),
    "LoadBatchVolume_yd3": (0.1, 30.0),
    "CalcYield_yd3": (0.1, 30.0),
    "AverageActualStrength28_psi": (100.0, 30000.0),
    "EffectiveSlump_in": (0.0, 20.0),
    "EffectiveAir_percent": (0.0, 20.0),
    "ApplicableSpecifiedStrength28": (500.0, 20000.0),
}

NULL_TOKENS = ["", "NULL", "null", "Null"]
MISSING_CATEGORY = "__MISSING__"
TRUE_TOKENS = ["true", "1", "yes", "y", "t"]
FLAG_TRUE_TOKENS = ["true", "yes", "y"]
FLAG_FALSE_TOKENS = ["false", "no", "n"]

# --------------------------------------------------------------------------
# Feature sets
# --------------------------------------------------------------------------
FIELD_FEATURES = [
    "EffectiveSlump_in",
    "EffectiveAir_percent",
    "EffectiveUnitWeight_lb_ft3",
    "EffectiveConcreteTemp_F",
    "AmbientTemp_F",
    "WaterAdded_gal_per_yd3",
    "BatchToSampleMinutes",
    "BatchToCastMinutes",
    "HasWaterAdded",
    "HasAnyAfterSPMeasurement",
]
DAY0_FEATURES = FIELD_FEATURES + [REQUIRED]
DAY7_FEATURES = [
    "Day7AverageStrength_psi",
    "Day7SpecimenCount",
    "Day7MarginToRequired_psi",
    "Day7ToRequiredRatio",
]
MISSING_INDICATORS = [
    "EffectiveSlumpMissing",
    "EffectiveSpreadMissing",
    "EffectiveAirMissing",
    "EffectiveUnitWeightMissing",
    "EffectiveConcreteTempMissing",
    "WaterAddedPerVolumeMissing",
    "InitialCuringConditionMissing",
]
FIELD_CORE_FEATURES = (
    [REQUIRED]
    + FRESH_COLUMNS
    + ["AmbientTemp_F", "WaterAdded_gal_per_yd3", "BatchToSampleMinutes", "BatchToCastMinutes"]
    + INDICATORS
    + MISSING_INDICATORS
)
SPEC_LIMIT_FEATURES = [f"{m.raw}_{side}" for m in MEASUREMENTS for side in ("specMin", "specMax")]
COMPLIANCE_FEATURES = (
    OUT_OF_SPEC_FLAGS
    + ["HasAnyFieldMeasurementWithSpec", "HasAnyFieldMeasurementOutOfSpec"]
    + [f"{m.label}{side}Amount" for m in MEASUREMENTS for side in ("BelowMin", "AboveMax")]
    + ["FieldOutOfSpecCount"]
)
DAY7_EXTENDED_FEATURES = [
    "AverageActualStrength7_psi",
    "MinimumActualStrength7_psi",
    "MaximumActualStrength7_psi",
    "ActualStrengthRange7_psi",
    "ActualStrength7SpecimenCount",
    "Strength7ToSpecifiedStrength28Ratio",
    "Strength7Margin_psi",
]
FEATURE_SETS = {
    "Day0_FieldCore": FIELD_CORE_FEATURES,
    "Day0_FieldPlusSpec": FIELD_CORE_FEATURES + SPEC_LIMIT_FEATURES,
    "Day0_FieldPlusCompliance": FIELD_CORE_FEATURES + SPEC_LIMIT_FEATURES + COMPLIANCE_FEATURES,
    "Day7_FieldPlusCompliance": FIELD_CORE_FEATURES
    + SPEC_LIMIT_FEATURES
    + COMPLIANCE_FEATURES
    + DAY7_EXTENDED_FEATURES,
}
LEAKAGE_COLUMNS = [
    "AverageActualStrength28_psi",
    "MinimumActualStrength28_psi",
    "MaximumActualStrength28_psi",
    "ActualStrengthRange28_psi",
    "StrengthMargin28_psi",
    "FailureFlag28",
    "FieldOutOfSpecAndStrengthFailure28",
    "BelowSpecifiedStrength28SpecimenCount",
    "AtOrAboveSpecifiedStrength28SpecimenCount",
    "UnevaluableStrength28SpecimenCount",
    "HasAnyBelowSpecifiedStrength28Specimen",
    "BelowSpecifiedStrength28SpecimenPercent",
    "ActualStrength7To28Ratio",
]
RECIPE_CORE = [
    "CalcCementContent_lbs_yd3",
    "FlyAshContent_lbs_yd3",
    "calcWCRatio",
    "SandSSD_lbs_yd3",
    "AggregateSSD_lbs_yd3",
]
RECIPE_OPTIONAL = [
    "SandMoisture_percent",
    "AggregateMoisture_percent",
    "WaterAdded_gal_per_yd3",
    "LoadBatchVolume_yd3",
    "CalcYield_yd3",
]
RECIPE_DERIVED = [
    "TotalCementitiousContent_lbs_yd3",
    "FlyAshFraction",
    "TotalAggregateSSD_lbs_yd3",
    "SandFractionOfAggregate",
]
RECIPE_FEATURES = RECIPE_CORE + RECIPE_OPTIONAL + RECIPE_DERIVED

# Alternative column names, in order of preference
CONTEXT_CANDIDATES = {
    "Supplier": ["SupplierId", "supplierId", "SupplierName", "supplierName"],
    "Plant": ["PlantNumber", "plantNumber", "PlantNo", "plantNo"],
    "Mix": ["MixNumber", "mixNumber", "MixNo", "mixNo"],
    "TestSubtype": ["testSubTypeId", "TestSubTypeId", "testSubtypeId"],
}

# Raw value, its not-applicable flag, and the label in the audit
NA_PAIRS = [
    ("WaterAddedRaw", "waterAddedNA", "Water added"),
    ("LoadBatchVolumeRaw", "LoadBatchVolumeNA", "Load/batch volume"),
    ("AmbientTempRaw", "ambientTempNA", "Ambient temperature"),
] + [
    (f"{raw}_{part}", f"{raw}_{part}NA", f"{label} {words}")
    for raw, label in (
        ("uwSlump", "Slump"),
        ("uwSpread", "Spread"),
        ("uwAir", "Air"),
        ("uwWeight", "Unit weight"),
        ("uwConcreteTemp", "Concrete temperature"),
    )
    for part, words in (
        ("actual", "actual"),
        ("afterSP", "after SP"),
        ("specMin", "spec minimum"),
        ("specMax", "spec maximum"),
    )
]

# Curing classes
CURING_CLASSES = [
    "Standard cured only",
    "Field cured only",
    "Both standard and field cured",
    "No strength result",
]

# Columns read from a specimen export, and those that stay text
SPECIMEN_COLUMNS = [
    "testId",
    "SpecimenRowId",
    "daysToAge",
    "wasFieldCured",
    "castDate",
    "batchTime",
    "sampleTime",
    "castTime",
    "testedOnDate",
    "SpecifiedBreakAge",
    "RequiredStrength",
    "DesignStrength",
    "ApplicableSpecifiedStrength",
    "ApplicableStrengthType",
    "RequiredStrengthRowCount",
    "DesignStrengthRowCount",
    "calcCompressiveStrength",
]

# Columns dropped from the test-level working set
WORKING_SET_DROPS = [
    "DesignStrength",
    "ApplicableSpecifiedStrength",
    "ApplicableStrengthType",
    "DesignStrengthRowCount",
    "RequiredStrengthRowCount",
    "ActualStrengthCV28_percent",
    "ActualStrengthStdDev28_psi",
    "MaximumActualAgeDays",
    "MinimumActualAgeDays",
    "MaximumActualStrength28_psi",
    "MinimumActualStrength28_psi",
    "MultipleStrengthRowsFlag",
    "OfficeName",
    "projectNo",
    "SandBatchWeight_lbs",
    "SandSSDWeight_lbs",
    "SandWaterWeight_lbs",
    "SandComponentCount",
    "AggregateBatchWeight_lbs",
    "AggregateSSDWeight_lbs",
    "AggregateWaterWeight_lbs",
    "AggregateComponentCount",
    "CementQuantity_lbs",
    "FlyAshQuantity_lbs",
    "waterQuantity",
    "WaterUnits",
    "CalcYield_yd3",
    "FlyAshFraction",
    "StandardCuredSpecimenCount28",
    "UniqueStandardCuredSpecimenCount28",
]

# --------------------------------------------------------------------------
# Decision grids
# --------------------------------------------------------------------------
MARGIN_THRESHOLDS = [float(t) for t in range(-500, 1501, 50)]
PROBABILITY_THRESHOLDS = [t / 1000 for t in range(50, 951, 25)]
RECALL_TARGETS = [0.80, 0.85, 0.90, 0.95]
MIN_FAILURE_RECALL = 0.80

# Review rules and their texts
MIN_PROJECT_TESTS = 30
MIN_GROUP_TESTS = 30
RISK_MIN_FAILURE_RATE = 5.0
RISK_P10_BELOW = 0.0
OPTIMIZE_MAX_FAILURE_RATE = 1.0
OPTIMIZE_MIN_MARGIN = 1200.0
OPTIMIZE_MAX_CV = 15.0
BENCHMARK_MAX_FAILURE_RATE = 1.0
BENCHMARK_MARGIN = (700.0, 1500.0)
BENCHMARK_MAX_CV = 15.0

FLAG_RISK = "Quality Risk"
FLAG_OPTIMIZE = "Potential Optimization Review"
FLAG_BENCHMARK = "Stable Benchmark"
FLAG_MONITOR = "Monitor"
ACTION_RISK = (
    "Review failures, production consistency, water control, curing, and data quality; "
    "do not reduce cementitious content."
)
ACTION_OPTIMIZE = (
    "Consistent high strength margin with low failure risk; materials engineer should review "
    "for trial-batch reduction or SCM substitution."
)
ACTION_ABOVE_MEDIAN = " Cementitious content is above the project/spec peer median."
ACTION_BELOW_MEDIAN = " Confirm comparable lower-cementitious benchmark mixes."
ACTION_BENCHMARK = (
    "Stable compliance with moderate strength margin and peer-level or lower cementitious "
    "content; use as a comparison mix."
)
ACTION_MONITOR = "No automatic action; retain for historical comparison and periodic review."

STATUS_CANDIDATE = "Mix Design Review Candidate"
STATUS_FEW = "Insufficient Data"
STATUS_RISK = "Below-Strength Risk"
STATUS_TAIL = "High Variability / Low Tail"
STATUS_OTHER = "Not Candidate"


class CandidateRule(NamedTuple):
    """Thresholds of the mix review."""

    min_tests: int
    min_mean_margin: float
    min_p05_margin: float
    max_failure_rate: float


# --------------------------------------------------------------------------
# Comparisons of experiments
# --------------------------------------------------------------------------
CONTEXT_PAIRS = {
    "Day0": ("Day0_FieldPlusRequired", "Day0_Context"),
    "Day7": ("Day7_FieldPlusRequired", "Full_ContextPlusDay7"),
}
R2_STEPS = [
    (
        "Complete-case cohort effect under original 05 split",
        "A_05_original_all_strength_rows",
        "B_05_split_complete_rows_batch_only",
    ),
    (
        "Actual slump/air effect under original 05 split",
        "B_05_split_complete_rows_batch_only",
        "C_05_split_complete_rows_plus_slump_air",
    ),
    (
        "Re-splitting effect after complete-case filtering",
        "B_05_split_complete_rows_batch_only",
        "D_05B_resplit_complete_rows_batch_only",
    ),
    (
        "Actual slump/air effect under 05B split",
        "D_05B_resplit_complete_rows_batch_only",
        "E_05B_resplit_complete_rows_plus_slump_air",
    ),
    (
        "Total observed difference: 05 original to 05B BatchOnly",
        "A_05_original_all_strength_rows",
        "D_05B_resplit_complete_rows_batch_only",
    ),
]

# Names of the value checks, in the order of their rules
SUSPICIOUS_FLAGS = [
    "NonPositive28DayStrength",
    "NonPositiveRequiredStrength",
    "NegativeSlump",
    "NegativeSpread",
    "NegativeAir",
    "NonPositiveUnitWeight",
    "NegativeWaterAddedPerVolume",
    "NonPositiveLoadBatchVolume",
    "BatchToSampleOver24Hours",
    "BatchToCastOver24Hours",
    "Extreme28DayStrength_IQRReview",
]
