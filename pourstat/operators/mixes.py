"""Mix performance: historical evaluation, mix review and recipe candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators.clean import keep_first, within
from pourstat.operators.order_stats import (
    exact_quantiles,
    rolling_mean,
    spread_row_number,
    value_bucket,
    with_percentile_rank,
    with_quantiles,
)
from pourstat.operators.profile import metric_rows
from pourstat.session import durable, shared

# --------------------------------------------------------------------------
# Historical evaluation
# --------------------------------------------------------------------------
GROUP = ["officeId", "projectId", "SupplierName", "plantNumber", "mixNumber", S.REQUIRED]
PEERS = ["officeId", "projectId", S.REQUIRED]


RECIPE_MEANS = {
    "AverageCementContent_lbs_yd3": "CalcCementContent_lbs_yd3",
    "AverageFlyAshContent_lbs_yd3": "FlyAshContent_lbs_yd3",
    "AverageTotalCementitious_lbs_yd3": "TotalCementitiousContent_lbs_yd3",
    "AverageWCRatio": "calcWCRatio",
    "AverageSlump_in": "EffectiveSlump_in",
    "AverageAir_percent": "EffectiveAir_percent",
}


def evaluation_columns() -> list[str]:
    return ["testId", *GROUP, S.TARGET, *RECIPE_MEANS.values()]


def evaluation_rows(df: DataFrame) -> DataFrame:
    """Identified tests with strength and requirement, one row per test, with margin.

    Only the columns of the evaluation are kept, because the rows are shared between
    branches and a persisted frame is not pruned any further.
    """
    narrow = df.select(*evaluation_columns())
    valid = narrow.dropna(how="any", subset=[*GROUP[:5], S.TARGET, S.REQUIRED])
    first = keep_first(valid, ["testId"], [F.col(c) for c in (*GROUP, S.TARGET)])
    margin = F.col(S.TARGET) - F.col(S.REQUIRED)
    return first.withColumns({"StrengthMargin_psi": margin, "StrengthFailure": E.flag(margin < 0)})


def project_summary(rows: DataFrame, min_tests: int = S.MIN_PROJECT_TESTS) -> DataFrame:
    """Size and failure rate per project, and whether it is large enough.

    Rows are one per test, as ``evaluation_rows`` leaves them. They are combined per supplier, plant
    and mix in the tasks first; distinct names are counted on that short table, not on the rows.
    """
    project = ["officeId", "projectId"]
    combined = rows.groupBy(*project, "SupplierName", "plantNumber", "mixNumber").agg(
        F.count("testId").alias("_tests"),
        F.sum(S.TARGET).alias("_sum"),
        F.count(S.TARGET).alias("_known"),
        F.sum("StrengthFailure").alias("_failed"),
    )
    out = combined.groupBy(*project).agg(
        F.sum("_tests").alias("ProjectTestCount"),
        F.count_distinct("SupplierName").alias("SupplierCount"),
        F.count_distinct("plantNumber").alias("PlantCount"),
        F.count_distinct("mixNumber").alias("MixCount"),
        E.safe_div(F.sum("_sum"), F.sum("_known")).alias(S.TARGET),
        F.sum("_failed").alias("FailureCount"),
    )
    return out.withColumns(
        {
            "FailureRate_percent": E.safe_div(F.col("FailureCount") * 100.0, "ProjectTestCount"),
            "EligibleProject": F.col("ProjectTestCount") >= min_tests,
        }
    )


def eligible_rows(rows: DataFrame, projects: DataFrame) -> DataFrame:
    keys = ["officeId", "projectId"]
    return rows.join(projects.where("EligibleProject").select(*keys), keys, "left_semi")


def mix_groups(rows: DataFrame) -> DataFrame:
    """Strength, margin, failure and recipe statistics per mix group of a project; rows are one per test."""
    rows = shared(rows)
    grouped = rows.groupBy(*GROUP).agg(
        F.count("testId").alias("TestCount"),
        F.avg(S.TARGET).alias("AverageActualStrength28_psi"),
        F.stddev_samp(S.TARGET).alias("StrengthStdDev_psi"),
        F.sum("StrengthFailure").alias("FailureCount"),
        F.avg("StrengthMargin_psi").alias("AverageSpecMargin_psi"),
        F.min("StrengthMargin_psi").alias("MinSpecMargin_psi"),
        *[F.avg(c).alias(n) for n, c in RECIPE_MEANS.items()],
        F.count("EffectiveSlump_in").alias("SlumpMeasurementCount"),
        F.count("EffectiveAir_percent").alias("AirMeasurementCount"),
    )
    # The requirement is part of the key, so margins rank like strengths and are not ranked again.
    # An endless requirement leaves the same margin for every strength.
    strength, required = F.col(S.TARGET).cast("double"), F.col(S.REQUIRED).cast("double")
    margin = F.when(F.abs(required) < float("inf"), strength - required).otherwise(-required)
    quantiles = exact_quantiles(
        rows,
        GROUP,
        S.TARGET,
        {"MedianActualStrength28_psi": 0.5},
        {"MedianSpecMargin_psi": (margin, 0.5), "P10SpecMargin_psi": (margin, 0.1)},
    )
    return grouped.join(quantiles, GROUP, "left").withColumns(
        {
            "StrengthCV_percent": E.safe_div(F.col("StrengthStdDev_psi") * 100.0, "AverageActualStrength28_psi"),
            "FailureRate_percent": E.safe_div(F.col("FailureCount") * 100.0, "TestCount"),
        }
    )


def with_peer_median(groups: DataFrame) -> DataFrame:
    """Peer median of cementitious content and the difference from it."""
    name = "ProjectSpecMedianCementitious_lbs_yd3"
    value = "AverageTotalCementitious_lbs_yd3"
    groups = durable(groups)
    medians = exact_quantiles(groups, PEERS, value, {name: 0.5})
    return groups.join(medians, PEERS, "left").withColumn(
        "CementitiousVsProjectMedian_percent",
        E.safe_div((F.col(value) - F.col(name)) * 100.0, name),
    )


def with_review_flag(groups: DataFrame) -> DataFrame:
    """First matching review rule with its action text and priority."""
    rate, p10 = F.col("FailureRate_percent"), F.col("P10SpecMargin_psi")
    margin, cv = F.col("AverageSpecMargin_psi"), F.col("StrengthCV_percent")
    versus = F.col("CementitiousVsProjectMedian_percent")
    risk = E.known_true(rate >= S.RISK_MIN_FAILURE_RATE) | E.known_true(p10 < S.RISK_P10_BELOW)
    optimize = E.known_true(
        (rate <= S.OPTIMIZE_MAX_FAILURE_RATE)
        & (margin >= S.OPTIMIZE_MIN_MARGIN)
        & (p10 > 0)
        & (cv <= S.OPTIMIZE_MAX_CV)
    )
    benchmark = E.known_true(
        (rate <= S.BENCHMARK_MAX_FAILURE_RATE)
        & margin.between(*S.BENCHMARK_MARGIN)
        & (p10 > 0)
        & (cv <= S.BENCHMARK_MAX_CV)
    ) & (versus.isNull() | (versus <= 0))
    compare = F.when(E.known_true(versus > 0), F.lit(S.ACTION_ABOVE_MEDIAN)).otherwise(F.lit(S.ACTION_BELOW_MEDIAN))

    def pick(a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.when(risk, a).when(optimize, b).when(benchmark, c).otherwise(d)

    return groups.withColumns(
        {
            "ReviewFlag": pick(*[F.lit(x) for x in (S.FLAG_RISK, S.FLAG_OPTIMIZE, S.FLAG_BENCHMARK, S.FLAG_MONITOR)]),
            "RecommendedAction": pick(
                F.lit(S.ACTION_RISK),
                F.concat(F.lit(S.ACTION_OPTIMIZE), compare),
                F.lit(S.ACTION_BENCHMARK),
                F.lit(S.ACTION_MONITOR),
            ),
            "ReviewPriority": pick(*[F.lit(i) for i in (1, 2, 3, 4)]),
        }
    )


def with_review_rank(flagged: DataFrame) -> DataFrame:
    """Rank inside the project: priority, failure rate, margin, cementitious content.

    Priority and a failure-rate bucket lead the order, so a large project is ranked
    in several tasks.
    """
    order = [
        F.desc("FailureRate_percent"),
        F.desc("AverageSpecMargin_psi"),
        F.desc_nulls_last("AverageTotalCementitious_lbs_yd3"),
        *[F.asc(c) for c in GROUP[2:]],
    ]
    coarse = shared(flagged).withColumn("_rate", value_bucket("FailureRate_percent"))
    return spread_row_number(
        coarse, ["officeId", "projectId"], [("ReviewPriority", True), ("_rate", False)], order, "ProjectReviewRank"
    ).drop("_rate")


def round_report(df: DataFrame, exempt: Sequence[str], digits: int = 3) -> DataFrame:
    """Half-even rounding of all double columns but the exempt ones."""
    return df.select(
        *[
            E.round_even(c, digits).alias(c) if t == "double" and c not in exempt else F.col(c)
            for c, t in df.dtypes
        ]
    )


def evaluate_history(
    df: DataFrame,
    min_project: int = S.MIN_PROJECT_TESTS,
    min_group: int = S.MIN_GROUP_TESTS,
    filters: HistoryFilters | None = None,
) -> DataFrame:
    """Eligibility, group statistics, peer comparison, review flag and rank of the wanted tests."""
    rows = shared(evaluation_rows(filters.apply(df) if filters else df))
    groups = mix_groups(eligible_rows(rows, project_summary(rows, min_project)))
    compared = with_peer_median(groups.where(F.col("TestCount") >= min_group))
    return round_report(with_review_rank(with_review_flag(compared)), ["officeId", "projectId"])


@dataclass(frozen=True)
class HistoryFilters:
    """Values a user wants to see; None takes all. Compared as trimmed text in any case."""

    office: Sequence[object] | None = None
    project: Sequence[object] | None = None
    supplier: Sequence[object] | None = None
    plant: Sequence[object] | None = None
    mix: Sequence[object] | None = None

    def conditions(self) -> dict[str, Column]:
        """One condition per filter, in the order they are applied."""
        columns = {"office": "officeId", "project": "projectId", "supplier": "SupplierName", "plant": "plantNumber", "mix": "mixNumber"}
        out = {}
        for name, column in columns.items():
            values = getattr(self, name)
            wanted = None if values is None else sorted({str(v).strip().lower() for v in values})
            out[name] = F.lit(True) if wanted is None else E.known_true(F.lower(F.trim(F.col(column).cast("string"))).isin(*wanted))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        for condition in self.conditions().values():
            df = df.where(condition)
        return df


def history_audit(
    df: DataFrame, filters: HistoryFilters = HistoryFilters(), min_project: int = S.MIN_PROJECT_TESTS, min_group: int = S.MIN_GROUP_TESTS
) -> DataFrame:
    """Rows, projects and groups left after every step of the evaluation, and rows per review flag.

    One aggregate over the input for the filters and one short table per later step, as
    (metric, value) rows. The columns of the evaluation are kept, so the input is worked out once.
    """
    df = shared(df.select(*evaluation_columns()))
    conditions = filters.conditions()
    named, kept = {}, F.lit(True)
    for name, condition in conditions.items():
        kept = kept & condition
        named[name] = kept
    complete = F.lit(True)
    for c in [*GROUP[:5], S.TARGET, S.REQUIRED]:
        complete = complete & F.col(c).isNotNull()
    first = df.agg(
        F.count(F.lit(1)).alias("input_rows"),
        E.count_if(named["office"]).alias("rows_after_office_filter"),
        E.count_if(named["project"]).alias("rows_after_project_filter"),
        E.count_if(named["mix"]).alias("rows_after_all_user_filters"),
        E.count_if(named["mix"] & ~complete).alias("rows_missing_identifier_strength_or_spec"),
    )
    rows = durable(evaluation_rows(filters.apply(df)))
    projects = durable(project_summary(rows, min_project))
    sized = projects.agg(
        F.coalesce(F.sum("ProjectTestCount"), F.lit(0)).alias("eligible_unique_test_rows"),
        F.count(F.lit(1)).alias("projects_before_minimum_test_filter"),
        E.count_if(F.col("EligibleProject")).alias("projects_meeting_minimum_test_count"),
        F.coalesce(F.sum(F.when(F.col("EligibleProject"), F.col("ProjectTestCount"))), F.lit(0)).alias("rows_in_eligible_projects"),
    )
    groups = durable(mix_groups(eligible_rows(rows, projects)))
    counted = groups.agg(
        F.count(F.lit(1)).alias("mix_groups_before_minimum_test_filter"),
        E.count_if(F.col("TestCount") >= min_group).alias("mix_groups_meeting_minimum_test_count"),
    )
    flagged = with_review_flag(with_peer_median(groups.where(F.col("TestCount") >= min_group)))
    flags = flagged.groupBy(F.concat(F.lit("review_flag: "), F.col("ReviewFlag")).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    out = flags
    for table in (first, sized, counted):
        out = out.unionByName(metric_rows(table, table.columns))
    return out.withColumn("value", F.coalesce("value", F.lit(0.0)))


def review_candidates(evaluation: DataFrame) -> DataFrame:
    """Groups that a materials engineer should look at: all but those to monitor."""
    return evaluation.where(F.col("ReviewFlag").isin(S.FLAG_RISK, S.FLAG_OPTIMIZE, S.FLAG_BENCHMARK))


# --------------------------------------------------------------------------
# Mix review
# --------------------------------------------------------------------------
REVIEW_KEYS = ["SupplierNameNormalized", "plantNumberNormalized", "mixNumberNormalized", "RequiredStrength"]


def review_rows(
    df: DataFrame,
    as_of: str | None = None,
    lookback_months: int | None = None,
    age_days: tuple[float, float] | None = None,
) -> DataFrame:
    """Usable 28-day rows with normalised group keys and the strength margin.

    With ``lookback_months`` only casts up to the as-of date (by default the latest
    cast date) and not older than the look-back are kept.
    """

    def named(c: str) -> Column:
        # The group key of a text is missing exactly for these values.
        return E.known_true(~F.lower(F.trim(c)).isin("", "nan", "none", "<na>"))

    keep = (
        (E.truthy("SpecifiedBreakAgeIs28") | E.known_true(F.col("SpecifiedBreakAge") == 28))
        & ~E.truthy("SpecifiedStrengthMissing")
        & (F.col("RequiredStrength") > 0)
        & (F.col(S.TARGET) > 0)
        & F.col("testId").isNotNull()
        & named("SupplierName")
        & named("mixNumber")
    )
    if age_days is not None:
        keep = keep & F.col("AverageActualAgeDays").between(*age_days)
    # Rows are filtered on plain columns before the text keys are derived.
    rows = df.where(keep)
    if lookback_months is not None:
        end = F.lit(as_of).cast("date") if as_of else df.agg(F.max("castDate")).scalar()
        rows = rows.withColumn("_end", end).where(
            F.col("castDate").between(F.add_months("_end", -lookback_months), F.col("_end"))
        ).drop("_end")
    labels = ("SupplierName", "plantNumber", "mixNumber")
    rows = rows.withColumns({c: F.when(~F.trim(c).isin("", "nan", "None", "<NA>"), F.trim(c)) for c in labels})
    rows = rows.withColumns({f"{c}Normalized": E.group_value(c) for c in labels})
    return rows.withColumns(
        {
            "plantNumber": F.coalesce("plantNumber", F.lit("<Unknown>")),
            "plantNumberNormalized": F.coalesce("plantNumberNormalized", F.lit("<UNKNOWN>")),
        }
    )


def collapse_tests(rows: DataFrame) -> DataFrame:
    """One row per test and mix group: mean strength, first cast date and labels."""
    out = rows.groupBy("testId", *REVIEW_KEYS).agg(
        *[F.min(c).alias(c) for c in ("SupplierName", "plantNumber", "mixNumber", "castDate", "SpecifiedBreakAge")],
        F.avg(S.TARGET).alias(S.TARGET),
        F.avg("AverageActualAgeDays").alias("AverageActualAgeDays"),
    )
    margin = F.col(S.TARGET) - F.col("RequiredStrength")
    return out.withColumns({"StrengthMargin_psi": margin, "IsBelowRequired": E.flag(margin < 0)})


def review_quality(source: DataFrame, rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Row counts along the review as (Metric, Value)."""
    one = tests.agg(
        F.count(F.lit(1)).alias("_tests"),
        F.count_distinct("testId").alias("UniqueTestsAfterDeduplication"),
        F.count_distinct(*REVIEW_KEYS).alias("DistinctMixGroups"),
    ).withColumns(
        {
            "OriginalRows": source.agg(F.count(F.lit(1))).scalar(),
            "RowsAfterFiltering": rows.agg(F.count(F.lit(1))).scalar(),
        }
    )
    one = one.withColumn("DuplicateRowsCollapsed", F.greatest(F.col("RowsAfterFiltering") - F.col("_tests"), F.lit(0)))
    return metric_rows(one.drop("_tests"), [c for c in one.columns if c != "_tests"], "Metric", "Value", "long")


def summarize_mixes(tests: DataFrame, rule: S.CandidateRule) -> DataFrame:
    """Margin statistics, peer percentiles, candidate flag and status per mix group."""
    m = "StrengthMargin_psi"
    tests = shared(tests)
    grouped = tests.groupBy(*REVIEW_KEYS).agg(
        *[F.min(c).alias(c) for c in ("SupplierName", "plantNumber", "mixNumber")],
        F.count_distinct("testId").alias("TestCount"),
        F.avg(S.TARGET).alias("MeanActualStrengthPsi"),
        F.avg(m).alias("MeanMarginPsi"),
        F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("StdDevMarginPsi"),
        F.min(m).alias("MinimumMarginPsi"),
        F.max(m).alias("MaximumMarginPsi"),
        F.sum("IsBelowRequired").alias("FailureCount"),
        F.min("castDate").alias("FirstCastDate"),
        F.max("castDate").alias("LastCastDate"),
    )
    grouped = with_quantiles(
        tests,
        grouped,
        REVIEW_KEYS,
        {
            S.TARGET: {"MedianActualStrengthPsi": 0.5},
            m: {"MedianMarginPsi": 0.5, "P05MarginPsi": 0.05, "P95MarginPsi": 0.95},
        },
    )
    grouped = grouped.withColumns(
        {
            "FailureRatePct": E.safe_div(F.col("FailureCount") * 100.0, "TestCount"),
            "CoefficientOfVariationPct": E.safe_div(F.col("StdDevMarginPsi") * 100.0, "MeanActualStrengthPsi"),
            "NormalApproxLower5MarginPsi": F.col("MeanMarginPsi") - F.col("StdDevMarginPsi") * F.lit(1.645),
        }
    )
    # The summary is small next to the tests; a checkpoint keeps the ranking plans short.
    grouped = durable(grouped)
    ranked = with_percentile_rank(grouped, ["RequiredStrength"], "MeanMarginPsi", "PeerPercentileWithinRequiredStrength")
    ranked = with_percentile_rank(
        ranked, ["SupplierNameNormalized", "RequiredStrength"], "MeanMarginPsi", "PeerPercentileWithinSupplierAndRequired"
    )
    return with_status(ranked, rule)


def with_status(summary: DataFrame, rule: S.CandidateRule) -> DataFrame:
    few = F.col("TestCount") < rule.min_tests
    risky = F.col("FailureRatePct") > rule.max_failure_rate
    low_tail = F.col("P05MarginPsi") < rule.min_p05_margin
    candidate = ~few & ~risky & ~low_tail & (F.col("MeanMarginPsi") >= rule.min_mean_margin)
    status = (
        F.when(candidate, F.lit(S.STATUS_CANDIDATE))
        .when(few, F.lit(S.STATUS_FEW))
        .when(risky, F.lit(S.STATUS_RISK))
        .when(low_tail, F.lit(S.STATUS_TAIL))
        .otherwise(F.lit(S.STATUS_OTHER))
    )
    return summary.withColumns({"IsReviewCandidate": candidate, "Status": status})


def review_report(summary: DataFrame, months: int) -> DataFrame:
    """Rounded summary with label and candidate message."""
    labelled = round_report(summary, ["RequiredStrength"], 2).withColumn("GroupLabel", E.group_label())
    return labelled.withColumn("Message", F.when(F.col("IsReviewCandidate"), E.candidate_message(months)))


def margin_trend(tests: DataFrame, candidates: DataFrame, rows: int = 5) -> DataFrame:
    """Rolling mean margin of the tests of candidate mix groups."""
    kept = tests.join(candidates.select(*REVIEW_KEYS), REVIEW_KEYS, "left_semi")
    return rolling_mean(kept, REVIEW_KEYS, "castDate", "testId", "StrengthMargin_psi", rows, "RollingMeanMarginPsi")


# --------------------------------------------------------------------------
# Recipe candidates
# --------------------------------------------------------------------------
def recipe_candidates(
    predicted: DataFrame,
    recipe: Sequence[str],
    p90_error: Column,
    required: float = 4000.0,
    safety_margin: float = 0.0,
    slump: tuple[float | None, float | None] = (None, None),
    air: tuple[float | None, float | None] = (None, None),
    objective: str = "CalcCementContent_lbs_yd3",
    n: int = 25,
) -> DataFrame:
    """Distinct past recipes whose cautious strength meets the requirement, least cement first."""
    distinct = keep_first(predicted, recipe, [F.col("testId")])
    cautious = distinct.withColumn("ConservativeStrength28_psi", F.col("PredictedStrength28_psi") - p90_error)
    ok = cautious.where(F.col("ConservativeStrength28_psi") >= required + safety_margin)
    if "PredictedSlump_in" in ok.columns:
        ok = within(ok, "PredictedSlump_in", *slump)
    if "PredictedAir_percent" in ok.columns:
        ok = within(ok, "PredictedAir_percent", *air)
    return ok.orderBy(F.asc(objective), F.desc("ConservativeStrength28_psi"), F.asc("testId")).limit(n)
