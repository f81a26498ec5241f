"""Metrics of prediction tables, computed per key without gathering predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators.order_stats import running_sums, selected_quantiles

ACTUAL, PREDICTED = "ActualStrength28_psi", "PredictedStrength28_psi"
FAILED, SCORE = "ActualFailureFlag", "FailureProbability"


def with_residuals(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Residual, absolute error and the two tolerance flags."""
    residual = F.col(predicted) - F.col(actual)
    return df.withColumns(
        {
            "ResidualPsi": residual,
            "AbsoluteErrorPsi": F.abs(residual),
            "Within300Psi": E.flag(F.abs(residual) <= 300.0),
            "Within500Psi": E.flag(F.abs(residual) <= 500.0),
        }
    )


def regression_metrics(
    df: DataFrame, keys: Sequence[str], actual: str = ACTUAL, predicted: str = PREDICTED, quantiles: bool = True
) -> DataFrame:
    """Error metrics per key; R2 is one minus the ratio of squared sums.

    Without ``quantiles`` the median and P90 errors are left out, which saves ranking.
    """
    rows = df.select(
        *keys, F.col(actual).alias("_y"), (F.col(predicted) - F.col(actual)).alias("_e")
    ).withColumn("_a", F.abs("_e"))
    sse, sst = F.sum(F.col("_e") * F.col("_e")), F.var_pop("_y") * F.count("_y")
    basic = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("RowCount"),
        F.avg("_a").alias("MAE"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("RMSE"),
        F.when(sst > 0, F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0)))
        .otherwise(F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .alias("R2"),
        F.avg("_e").alias("MeanBias"),
        (F.avg(E.flag(F.col("_a") <= 300.0)) * 100.0).alias("Within300PsiPercent"),
        (F.avg(E.flag(F.col("_a") <= 500.0)) * 100.0).alias("Within500PsiPercent"),
    )
    if not quantiles:
        return basic
    return basic.join(
        selected_quantiles(rows, keys, "_a", {"MedianAE": 0.5, "P90AbsoluteError": 0.9}), list(keys)
    )


def yearly(metrics: DataFrame, rows: str = "RowCount") -> DataFrame:
    """Metrics by year leave out years with fewer than two rows."""
    return metrics.where(F.col(rows) >= 2)


def band_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, error and bias per key and strength band."""
    from pourstat.operators.clean import STRENGTH_EDGES, STRENGTH_LABELS

    banded = with_residuals(df).withColumn("StrengthBand", E.band(ACTUAL, STRENGTH_EDGES, STRENGTH_LABELS))
    return banded.where(F.col("StrengthBand").isNotNull()).groupBy(*keys, "StrengthBand").agg(
        F.count(F.lit(1)).alias("RowCount"),
        F.avg("AbsoluteErrorPsi").alias("MAE"),
        F.avg("ResidualPsi").alias("MeanBias"),
    )


def error_by_range(df: DataFrame) -> DataFrame:
    """Error statistics per right-closed strength range."""
    from pourstat.operators.clean import ERROR_EDGES, interval_labels

    ranged = with_residuals(df).withColumn(
        "StrengthRange", E.band(ACTUAL, ERROR_EDGES, interval_labels(ERROR_EDGES, True), right=True)
    )
    ranged = ranged.where(F.col("StrengthRange").isNotNull())
    stats = ranged.groupBy("StrengthRange").agg(
        F.count(F.lit(1)).alias("TestCount"),
        F.avg("AbsoluteErrorPsi").alias("MAE"),
        F.avg(ACTUAL).alias("ActualMean"),
        F.avg(PREDICTED).alias("PredictedMean"),
    )
    return stats.join(
        selected_quantiles(ranged, ["StrengthRange"], "AbsoluteErrorPsi", {"MedianError": 0.5}), "StrengthRange"
    )


# --------------------------------------------------------------------------
# Classification
# --------------------------------------------------------------------------
def confusion(actual: Column, predicted: Column) -> dict[str, Column]:
    """Counts of a 0/1 decision as aggregates."""
    return {
        "TruePositives": E.count_if((actual == 1) & (predicted == 1)),
        "FalsePositives": E.count_if((actual == 0) & (predicted == 1)),
        "FalseNegatives": E.count_if((actual == 1) & (predicted == 0)),
        "TrueNegatives": E.count_if((actual == 0) & (predicted == 0)),
    }


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Recall, precision and F1; 0 where a denominator is empty."""
    zero = F.lit(0.0)
    return {
        "Recall": F.coalesce(E.safe_div(tp, tp + fn), zero),
        "Precision": F.coalesce(E.safe_div(tp, tp + fp), zero),
        "F1": F.coalesce(E.safe_div(tp * 2, tp * 2 + fp + fn), zero),
    }


def threshold_metrics(
    df: DataFrame, keys: Sequence[str], threshold: float = 0.5, actual: str = FAILED, score: str = SCORE
) -> DataFrame:
    """Decision metrics at one threshold with the failure rate and Brier score."""
    a, p = F.col(actual), E.flag(F.col(score) >= threshold)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("RowCount"),
        (F.avg(a) * 100.0).alias("FailureRatePercent"),
        F.avg((F.col(score) - a) * (F.col(score) - a)).alias("BrierScore"),
        *[c.alias(n) for n, c in confusion(a, p).items()],
    )
    return out.withColumns(
        {
            **rates(F.col("TruePositives"), F.col("FalsePositives"), F.col("FalseNegatives")),
            "Threshold": F.lit(float(threshold)),
        }
    )


def ranking_metrics(df: DataFrame, keys: Sequence[str], actual: str = FAILED, score: str = SCORE) -> DataFrame:
    """Average precision (step-wise) and ROC AUC with tied scores counted half."""
    sums = score_sums(df, keys, actual, score)
    pos, n = F.col("pos"), F.col("n")
    positives = F.col("pos_total")
    negatives = F.col("n_total") - positives
    lower = negatives - (F.col("n_upto") - F.col("pos_upto"))
    return (
        sums.groupBy(*keys)
        .agg(
            F.coalesce(
                F.sum(E.safe_div(pos, positives) * F.col("pos_upto") / F.col("n_upto")), F.lit(0.0)
            ).alias("AveragePrecision_PR_AUC"),
            E.safe_div(F.sum(pos * (lower + (n - pos) * 0.5)), F.max(positives * negatives)).alias("ROC_AUC"),
        )
    )


def score_sums(df: DataFrame, keys: Sequence[str], actual: str = FAILED, score: str = SCORE) -> DataFrame:
    """Running positives and rows by falling score, one row per distinct score."""
    return running_sums(df, keys, score, {"pos": F.col(actual).cast("long"), "n": F.lit(1).cast("long")}, descending=True)


def classification_metrics(df: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    return threshold_metrics(df, keys, threshold).join(ranking_metrics(df, keys), list(keys))


# --------------------------------------------------------------------------
# Cross-validation summaries
# --------------------------------------------------------------------------
def cv_summary(
    folds: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    population: bool = False,
    higher_is_better: Sequence[str] = ("R2",),
) -> DataFrame:
    """Mean, deviation, best and worst fold of each metric."""
    deviation = F.stddev_pop if population else F.stddev_samp
    aggs = [F.count(F.lit(1)).alias("FoldCount"), F.sum("RowCount").alias("TotalValidationRows")]
    for m in metrics:
        best, worst = (F.max, F.min) if m in higher_is_better else (F.min, F.max)
        aggs += [
            F.avg(m).alias(f"MeanCV_{m}"),
            deviation(m).alias(f"StdCV_{m}"),
            best(m).alias(f"BestFold_{m}"),
            worst(m).alias(f"WorstFold_{m}"),
        ]
    return folds.groupBy(*keys).agg(*aggs)


def with_stability(summary: DataFrame) -> DataFrame:
    """Range and relative deviation of the fold errors."""
    return summary.withColumns(
        {
            "MAE_Range": F.col("WorstFold_MAE") - F.col("BestFold_MAE"),
            "MAE_CV_Percent": E.safe_div("StdCV_MAE", "MeanCV_MAE") * 100.0,
        }
    )


def agreement(df: DataFrame, keys: Sequence[str], first: str, second: str, actual: str = FAILED) -> DataFrame:
    """How often two 0/1 decisions agree and what their one-sided alerts hit."""
    a, b = F.col(first), F.col(second)
    only_b, only_a = (a == 0) & (b == 1), (a == 1) & (b == 0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("Rows"),
        (F.avg(E.flag(a == b)) * 100.0).alias("AgreementPercent"),
        (F.avg(E.flag(a != b)) * 100.0).alias("DisagreementPercent"),
        E.count_if(only_b).alias("ClassifierOnlyAlerts"),
        E.count_if(only_b & (F.col(actual) == 1)).alias("ClassifierOnlyActualFailures"),
        E.count_if(only_a).alias("RegressionOnlyAlerts"),
        E.count_if(only_a & (F.col(actual) == 1)).alias("RegressionOnlyActualFailures"),
    )
