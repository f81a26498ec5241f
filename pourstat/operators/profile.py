"""Profiles and audits. Columns become rows and are counted in one distributed pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators.order_stats import average_ranks, exact_quantiles, selected_quantiles, top_rows, unpivot

# Quantiles of the numeric profile
PROFILE_QUANTILES = {"P01": 0.01, "P05": 0.05, "P25": 0.25, "Median": 0.5, "P75": 0.75, "P95": 0.95, "P99": 0.99}
MISSING_VALUE = "<missing>"


def metric_rows(one_row: DataFrame, metrics: Sequence[str], name: str = "metric", value: str = "value", as_type: str = "double") -> DataFrame:
    """A one-row aggregate as (metric, value) rows."""
    return unpivot(one_row, [], metrics, name, value, as_type)


def column_missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing, distinct and zero counts, one row per column.

    Each (column, value) pair is counted with a map-side combine first, so the step
    per column only sees distinct values.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    values = unpivot(df, [], columns, "Column", "Value", "string")
    distinct = values.groupBy("Column", "Value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("Value").isNotNull()
    return (
        distinct.groupBy("Column")
        .agg(
            F.sum("n").alias("RowCount"),
            F.sum(F.when(known, F.col("n")).otherwise(F.lit(0))).alias("NonMissingCount"),
            F.sum(F.when(~known, F.col("n")).otherwise(F.lit(0))).alias("MissingCount"),
            E.count_if(known).alias("UniqueNonNullCount"),
            F.sum(F.when(E.number("Value") == 0, F.col("n")).otherwise(F.lit(0))).alias(
                "ZeroCountNumericInterpretation"
            ),
        )
        .withColumn("MissingPercent", E.percent_even(F.col("MissingCount"), F.col("RowCount")))
        .withColumn("DType", F.try_element_at(dtype, F.col("Column")))
    )


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, moments and exact quantiles; absent columns give a row without values."""
    found = {c for c in columns if c in df.columns}
    wide = df.select(
        *[(F.col(c).cast("double") if c in found else F.lit(None).cast("double")).alias(c) for c in columns]
    )
    long = unpivot(wide, [], columns)
    v = F.col("Value")
    present = F.col("Column").isin(*found)
    stats = long.groupBy("Column").agg(
        F.count(F.lit(1)).alias("RowCount"),
        F.count(v).alias("NonMissingCount"),
        E.count_if(v.isNull()).alias("MissingCount"),
        E.count_if(v == 0).alias("ZeroCount"),
        E.count_if(v < 0).alias("NegativeCount"),
        F.min(v).alias("Min"),
        F.avg(v).alias("Mean"),
        F.max(v).alias("Max"),
        F.stddev_samp(v).alias("Std"),
    )
    stats = stats.withColumn("MissingPercent", E.percent_even(F.col("MissingCount"), F.col("RowCount")))
    per_column = ["NonMissingCount", "MissingCount", "ZeroCount", "NegativeCount", "MissingPercent"]
    stats = stats.withColumns(
        {**{c: F.when(present, F.col(c)) for c in per_column}, "PresentInFile": E.flag(present)}
    )
    return stats.join(selected_quantiles(long, ["Column"], "Value", PROFILE_QUANTILES), "Column", "left")


def field_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct-value profile of all columns, with normalised counts for text."""
    columns = list(columns or df.columns)
    text = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, (T.StringType, T.BooleanType))]
    values = unpivot(df, [], columns, "Column", "Value", "string")
    is_text = F.col("Column").isin(*text) if text else F.lit(False)
    distinct = (
        values.groupBy("Column", "Value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_norm", F.when(is_text, E.comparison_value("Value")))
    )
    # A first step per (column, normalised value) keeps the distinct counts combinable.
    by_norm = distinct.groupBy("Column", "_norm").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("Value").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("known"),
        F.count("Value").alias("unique"),
    )
    out = by_norm.groupBy("Column").agg(
        F.sum("rows").alias("RowCount"),
        F.sum("known").alias("NonNullCount"),
        F.sum("unique").alias("UniqueCount"),
        F.count("_norm").alias("_norms"),
    )
    unique, known = F.col("UniqueCount"), F.col("NonNullCount")
    return out.withColumns(
        {
            "NullCount": F.col("RowCount") - known,
            "NullPercent": E.percent_even(F.col("RowCount") - known, F.col("RowCount")),
            "UniquePercentOfNonNull": E.percent_even(unique, known),
            "IsAllNull": known == 0,
            "IsConstant": unique <= 1,
            "IsLikelyIdentifier": (known > 0) & (unique == known),
            "NormalizedUniqueCount": F.when(is_text, F.col("_norms")),
            "PotentialFormattingDuplicateCount": F.when(is_text, unique - F.col("_norms")),
        }
    ).drop("_norms")


def category_frequency(df: DataFrame, columns: Sequence[str], missing: str = MISSING_VALUE) -> DataFrame:
    """Rows and share of every value of the chosen columns."""
    values = unpivot(df, [], columns, "Column", "Value", "string").withColumn(
        "Value", F.coalesce("Value", F.lit(missing))
    )
    counts = values.groupBy("Column", "Value").agg(F.count(F.lit(1)).alias("TestCount"))
    totals = counts.groupBy("Column").agg(F.sum("TestCount").alias("_rows"))
    return (
        counts.join(totals, "Column")
        .withColumn("Percent", E.percent_even(F.col("TestCount"), F.col("_rows")))
        .drop("_rows")
    )


def top_values(df: DataFrame, columns: Sequence[str], n: int = 30) -> DataFrame:
    """The most frequent values of each column with rank, share and normalised form."""
    values = unpivot(df, [], columns, "Column", "OriginalValue", "string")
    counts = values.groupBy("Column", "OriginalValue").agg(F.count(F.lit(1)).alias("Count"))
    totals = counts.groupBy("Column").agg(F.sum("Count").alias("_rows"))
    ranked = top_rows(
        counts, ["Column"], [F.desc("Count"), F.col("OriginalValue").asc_nulls_first()], n, rank="Rank"
    )
    return (
        ranked.join(totals, "Column")
        .withColumns(
            {
                "NormalizedComparisonValue": E.comparison_value("OriginalValue"),
                "Percent": E.percent_even(F.col("Count"), F.col("_rows")),
            }
        )
        .drop("_rows")
    )


def formatting_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that differ only in case or spacing, listed in one row; blank values have no variants.

    Values are counted first, so only those with a variant are listed.
    """
    values = unpivot(df, [], columns, "Column", "OriginalValue", "string")
    distinct = (
        values.withColumn("NormalizedValue", E.comparison_value("OriginalValue"))
        .where(F.col("NormalizedValue").isNotNull())
        .groupBy("Column", "NormalizedValue", "OriginalValue")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = ["Column", "NormalizedValue"]
    several = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_variants")).where(F.col("_variants") > 1)
    return distinct.join(several, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("OriginalVariantCount"),
        F.sum("n").alias("TotalRowCount"),
        F.array_join(F.array_sort(F.collect_list("OriginalValue")), " | ").alias("OriginalVariants"),
    )


def curing_text_frequency(df: DataFrame, column: str) -> DataFrame:
    renamed = df.select(E.curing_text(column).alias("InitialCuringConditionNormalizedText"))
    return category_frequency(renamed, ["InitialCuringConditionNormalizedText"]).select(
        F.col("Value").alias("InitialCuringConditionNormalizedText"), "TestCount", "Percent"
    )


def curing_text_stats(df: DataFrame, column: str) -> DataFrame:
    """Missing, unique and single-occurrence counts of the curing text."""
    counts = df.groupBy(E.curing_text(column).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("text").isNotNull()
    return counts.agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("InitialCuringNonMissingCount"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("InitialCuringMissingCount"),
        E.count_if(known).alias("InitialCuringUniqueCleanCount"),
        E.count_if(known & (F.col("n") == 1)).alias("InitialCuringSingleOccurrenceValueCount"),
    )


# --------------------------------------------------------------------------
# Not-applicable audit
# --------------------------------------------------------------------------
def _na_pairs(df: DataFrame) -> list[tuple[str, str, str]]:
    return [p for p in S.NA_PAIRS if p[0] in df.columns or p[1] in df.columns]


def _pair_values(df: DataFrame, raw: str, na: str) -> tuple[Column, Column]:
    value = E.number(raw) if raw in df.columns else F.lit(None).cast("double")
    flag = E.flag_value(na) if na in df.columns else F.lit(None).cast("int")
    return value, flag


def ambiguous_zero_count(df: DataFrame) -> Column:
    """Pairs of a row whose value is zero while the flag is missing."""
    total = F.lit(0)
    for raw, na, _ in _na_pairs(df):
        value, flag = _pair_values(df, raw, na)
        total = total + E.flag((value == 0) & flag.isNull())
    return total


def na_pair_rows(df: DataFrame, keep: Sequence[Column] = ()) -> DataFrame:
    """One row per input row and (value, flag) pair."""
    items = []
    for raw, na, label in _na_pairs(df):
        value, flag = _pair_values(df, raw, na)
        items.append(
            F.struct(
                F.lit(label).alias("Field"),
                F.lit(raw if raw in df.columns else None).alias("RawColumn"),
                F.lit(na if na in df.columns else None).alias("NAFlagColumn"),
                value.alias("raw"),
                flag.alias("na"),
            )
        )
    return df.select(*keep, F.explode(F.array(*items)).alias("p")).select(
        *[c for c in ("CastYear",) if keep], "p.*"
    )


def na_audit(df: DataFrame) -> DataFrame:
    """Twelve counts per (value, flag) pair."""
    raw, na = F.col("raw"), F.col("na")
    counts = {
        "RawNonMissingCount": raw.isNotNull(),
        "RawMissingCount": raw.isNull(),
        "NAFlagPopulatedCount": na.isNotNull(),
        "NAFlagNullCount": na.isNull(),
        "NAFlagTrueCount": na == 1,
        "NAFlagFalseCount": na == 0,
        "RawZeroCount": raw == 0,
        "ZeroWithNAFlagTrueCount": (raw == 0) & (na == 1),
        "ZeroWithNAFlagFalseCount": (raw == 0) & (na == 0),
        "ZeroWithNAFlagNull_AmbiguousCount": (raw == 0) & na.isNull(),
        "PositiveValueWithNAFlagTrue_ConflictCount": (raw > 0) & (na == 1),
        "MissingRawWithNAFlagFalseCount": raw.isNull() & (na == 0),
    }
    return (
        na_pair_rows(df)
        .groupBy("Field", "RawColumn", "NAFlagColumn")
        .agg(F.count(F.lit(1)).alias("TotalRows"), *[E.count_if(c).alias(n) for n, c in counts.items()])
    )


def na_audit_by_year(df: DataFrame, date: str = "castDate") -> DataFrame:
    """Use of values and flags per pair and cast year."""
    rows = na_pair_rows(df, [F.year(date).alias("CastYear")]).where(F.col("CastYear").isNotNull())
    raw, na = F.col("raw"), F.col("na")
    return rows.groupBy("Field", "CastYear").agg(
        F.count(F.lit(1)).alias("RowCount"),
        F.count(raw).alias("RawPresentCount"),
        F.count(na).alias("NAFlagPresentCount"),
        E.count_if(na == 1).alias("NAFlagTrueCount"),
        E.count_if(raw == 0).alias("RawZeroCount"),
        E.count_if((raw == 0) & na.isNull()).alias("ZeroWithNAFlagNull_AmbiguousCount"),
    )


# --------------------------------------------------------------------------
# Curing
# --------------------------------------------------------------------------
def with_curing_class(df: DataFrame) -> DataFrame:
    """Which curing results a test has at 7 and 28 days."""
    standard_only, field_only, both, none = S.CURING_CLASSES
    cols: dict[str, Column] = {}
    for age in (7, 28):
        std = F.coalesce(F.col(f"ActualStrength{age}SpecimenCount"), F.lit(0)) > 0
        fld = F.coalesce(F.col(f"FieldCuredStrength{age}SpecimenCount"), F.lit(0)) > 0
        cols[f"HasStandardCured{age}"] = E.flag(std)
        cols[f"HasFieldCured{age}"] = E.flag(fld)
        cols[f"CuringAvailability{age}"] = (
            F.when(std & fld, F.lit(both))
            .when(std, F.lit(standard_only))
            .when(fld, F.lit(field_only))
            .otherwise(F.lit(none))
        )
    return df.withColumns(cols)


def curing_summary(classed: DataFrame) -> DataFrame:
    """Tests and share per age and class; classes without tests stay with zero."""
    counted = classed.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            E.count_if(F.col(f"CuringAvailability{age}") == name).alias(f"{age}_{i}")
            for age in (7, 28)
            for i, name in enumerate(S.CURING_CLASSES)
        ],
    )
    rows = [
        F.struct(
            F.lit(age).alias("BreakAgeDays"),
            F.lit(name).alias("CuringResultAvailability"),
            F.col(f"{age}_{i}").alias("ConcreteTestCount"),
            E.percent_even(F.col(f"{age}_{i}"), F.col("_rows")).alias("Percent"),
        )
        for age in (7, 28)
        for i, name in enumerate(S.CURING_CLASSES)
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def curing_breakdown(classed: DataFrame, group: Column, name: str, share: str, keep_missing: bool) -> DataFrame:
    """28-day classes per year or office with the share inside the group.

    The window runs over at most four rows per group, after aggregation.
    """
    rows = classed.select(group.alias(name), "CuringAvailability28")
    if not keep_missing:
        rows = rows.where(F.col(name).isNotNull())
    counts = rows.groupBy(name, "CuringAvailability28").agg(F.count(F.lit(1)).alias("ConcreteTestCount"))
    total = F.sum("ConcreteTestCount").over(Window.partitionBy(name))
    return counts.withColumn(share, E.percent_even(F.col("ConcreteTestCount"), total))


def subtype_readiness(classed: DataFrame, column: str = "testSubTypeId") -> DataFrame:
    """Available results per test subtype with three coverage shares."""
    has = {
        "TestsWithActual7": F.col(S.DAY7).isNotNull(),
        "TestsWithActual28": F.col(S.TARGET).isNotNull(),
        "TestsWithRequired28": F.col(S.REQUIRED).isNotNull(),
        "TestsWithAnyFreshMeasurement": E.has_any([c for c in S.FRESH_COLUMNS if c in classed.columns]),
        "TestsWithStandardCured28": F.col("HasStandardCured28") == 1,
        "TestsWithFieldCured28": F.col("HasFieldCured28") == 1,
    }
    rows = F.count(F.lit(1))
    shares = {
        "Actual28CoveragePercent": "TestsWithActual28",
        "FreshMeasurementCoveragePercent": "TestsWithAnyFreshMeasurement",
        "FieldCured28Percent": "TestsWithFieldCured28",
    }
    return classed.groupBy(
        F.coalesce(F.col(column).cast("string"), F.lit(MISSING_VALUE)).alias(column)
    ).agg(
        rows.alias("ConcreteTestCount"),
        *[E.count_if(c).alias(n) for n, c in has.items()],
        *[E.percent_even(E.count_if(has[src]), rows).alias(n) for n, src in shares.items()],
    )


# --------------------------------------------------------------------------
# Summaries
# --------------------------------------------------------------------------
def flag_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows and share per 0/1 flag."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).cast("long").alias(c) for c in flags])
    rows = [
        F.struct(
            F.lit(c).alias("ReviewFlag"),
            F.col(c).alias("RowCount"),
            E.percent_even(F.col(c), F.col("_rows")).alias("Percent"),
        )
        for c in flags
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feature_coverage(df: DataFrame, sets: Mapping[str, Sequence[str]] = S.FEATURE_SETS) -> DataFrame:
    """Non-null count and share of every column of every feature set."""
    columns = sorted({c for cols in sets.values() for c in cols})
    found = [c for c in columns if c in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in found])
    rows = [
        F.struct(
            F.lit(name).alias("feature_set"),
            F.lit(c).alias("column"),
            F.lit(int(c in found)).alias("column_present"),
            (F.col(c) if c in found else F.lit(0).cast("long")).alias("non_null_count"),
            (E.percent_even(F.col(c), F.col("_rows")) if c in found else E.percent_even(F.lit(0), F.col("_rows"))).alias(
                "coverage_percent"
            ),
        )
        for name, cols in sets.items()
        for c in dict.fromkeys(cols)
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cohort_summary(df: DataFrame) -> DataFrame:
    """Eligible rows, failures and failure rate as (metric, value)."""
    classified = F.col(S.FAILURE).isNotNull()
    failures = F.coalesce(F.sum(S.FAILURE), F.lit(0))
    one = df.agg(
        F.count(F.lit(1)).alias("all_cleaned_rows"),
        E.count_if(F.col(S.TARGET).isNotNull() & F.col(S.REQUIRED).isNotNull()).alias("regression_eligible_rows"),
        E.count_if(classified).alias("classification_eligible_rows"),
        E.count_if(classified & F.col(S.DAY7).isNotNull()).alias("day7_eligible_rows"),
        failures.alias("failure_rows"),
        E.round_even(E.safe_div(failures.cast("double") * 100.0, E.count_if(classified)), 3).alias(
            "failure_rate_percent"
        ),
    )
    return metric_rows(one, one.columns)


def preparation_overview(marked: DataFrame) -> DataFrame:
    """Counts of the preparation run as (Metric, CountOrValue, PercentOfAllRows)."""
    c = F.col
    flags = {
        "Rows belonging to duplicated test IDs": c("DuplicateTestId") == 1,
        "US unit-system rows": c("ValidUSUnitSystem") == 1,
        "Rows with valid cast date": c("ValidCastDateForModel") == 1,
        "Rows with actual 7-day standard-cured strength": c(S.DAY7).isNotNull(),
        "Rows with actual 28-day standard-cured strength": c(S.TARGET).isNotNull(),
        "Rows with applicable required/design 28-day strength": c(S.REQUIRED).isNotNull(),
        "Rows with any effective fresh measurement": c("AvailableFreshMeasurementCount") > 0,
        "Rows with all effective fresh measurements": c("AvailableFreshMeasurementCount") == len(S.MEASUREMENTS),
        "Field Core base model candidates": c("FieldCoreBaseEligible") == 1,
        "Field Core candidates with required strength": c("FieldCoreWithRequiredEligible") == 1,
        "Complete-case Field Core candidates": c("FieldCoreCompleteCase") == 1,
        "Rows with at least one ambiguous legacy zero/N/A pair": c("LegacyZeroNAAmbiguityCount") > 0,
        "28-day standard-cured only": c("CuringAvailability28") == S.CURING_CLASSES[0],
        "28-day field-cured only": c("CuringAvailability28") == S.CURING_CLASSES[1],
        "28-day both standard and field cured": c("CuringAvailability28") == S.CURING_CLASSES[2],
        "28-day no strength result": c("CuringAvailability28") == S.CURING_CLASSES[3],
    }
    valid_day = F.when(c("ValidCastDateForModel") == 1, c("castDate"))
    one = marked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("testId").alias("tests"),
        *[E.count_if(cond).alias(f"f{i}") for i, cond in enumerate(flags.values())],
        F.min(valid_day).cast("string").alias("first"),
        F.max(valid_day).cast("string").alias("last"),
    )

    def row(metric: str, value: Column, share: bool = True) -> Column:
        percent = E.percent_even(value, F.col("rows")) if share else F.lit(None).cast("double")
        return F.struct(
            F.lit(metric).alias("Metric"), value.cast("string").alias("CountOrValue"), percent.alias("PercentOfAllRows")
        )

    rows = [row("Total records", F.col("rows")), row("Unique concrete tests", F.col("tests"))]
    rows += [row(name, F.col(f"f{i}")) for i, name in enumerate(flags)]
    rows += [
        row("Earliest valid cast date", F.col("first"), False),
        row("Latest valid cast date", F.col("last"), False),
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def target_summary(df: DataFrame, keys: Sequence[str], target: str, group: str, population: bool = False) -> DataFrame:
    """Rows, groups and target statistics per split or fold."""
    deviation = F.stddev_pop if population else F.stddev_samp
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("RowCount"),
        F.count_distinct(group).alias("UniqueGroups"),
        F.avg(target).alias("TargetMean"),
        deviation(target).alias("TargetStd"),
        F.min(target).alias("TargetMin"),
        F.max(target).alias("TargetMax"),
    )
    return stats.join(selected_quantiles(df, keys, target, {"TargetMedian": 0.5}), list(keys), "left")


def grain_check(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, repeated rows and missing keys of a key column."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(key).isNotNull()
    return counts.agg(
        F.sum("n").alias("RowCount"),
        E.count_if(known).alias("DistinctKeys"),
        F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("RowsInRepeatedKeys"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("RowsWithoutKey"),
    )


def assert_unique(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Fail with examples when a key repeats; runs one small job."""
    keys = [key] if isinstance(key, str) else list(key)
    repeated = df.groupBy(*keys).count().where("count > 1").limit(10).collect()
    if repeated:
        raise ValueError(f"key {keys} is not unique, for example {[tuple(r)[:-1] for r in repeated]}")
    return df


# --------------------------------------------------------------------------
# Data behind the charts
# --------------------------------------------------------------------------
def spearman(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every column pair over complete rows."""
    rows = df.dropna(how="any", subset=list(columns)).select(key, *columns)
    long = unpivot(rows, [key], columns)
    ranked = long.join(average_ranks(long, ["Column"], "Value"), ["Column", "Value"])
    wide = ranked.groupBy(key).agg(
        *[F.max(F.when(F.col("Column") == c, F.col("AverageRank"))).alias(c) for c in columns]
    )
    pairs = [(a, b) for a in columns for b in columns]
    one = wide.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    items = [
        F.struct(F.lit(a).alias("Column"), F.lit(b).alias("OtherColumn"), F.col(f"{i}").alias("Spearman"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    v = F.col(column)
    ranged = df.where(v.isNotNull()).select(column).withColumn("_span", span.select(F.struct("lo", "hi")).scalar())
    lo, width = F.col("_span.lo"), (F.col("_span.hi") - F.col("_span.lo")) / F.lit(float(bins))
    index = F.least(F.floor((v - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return (
        ranged.groupBy(F.coalesce(index, F.lit(0)).alias("Bin"), lo.alias("lo"), width.alias("w"))
        .agg(F.count(F.lit(1)).alias("RowCount"))
        .select("Bin", (F.col("lo") + F.col("Bin") * F.col("w")).alias("BinStart"), "RowCount")
    )


def box_statistics(df: DataFrame, group: str, value: str, min_rows: int = 5) -> DataFrame:
    """Quartiles and extremes per group with enough rows."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    stats = (
        rows.groupBy(group)
        .agg(F.count(F.lit(1)).alias("RowCount"), F.min(value).alias("Min"), F.max(value).alias("Max"))
        .where(F.col("RowCount") >= min_rows)
    )
    return stats.join(exact_quantiles(rows, [group], value, {"P25": 0.25, "Median": 0.5, "P75": 0.75}), group)
