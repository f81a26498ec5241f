"""Decision analysis on prediction tables: alignment, sweeps and best rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import metrics as M
from pourstat.operators.order_stats import selected_quantiles, top_rows
from pourstat.operators.profile import assert_unique
from pourstat.session import shared


# --------------------------------------------------------------------------
# Checked joins
# --------------------------------------------------------------------------
def merge_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that fails when a key repeats on either side."""
    return assert_unique(left, keys).join(assert_unique(right, keys), list(keys), how)


def unique_or_raise(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; a key that repeats raises when the rows are read.

    The count runs on the partitioning by key that a join on it needs anyway.
    """
    rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    wrong = F.raise_error(F.lit(f"key {list(keys)} is not unique"))
    return df.withColumn("_rows", rows).where(F.when(F.col("_rows") > 1, wrong).otherwise(F.lit(True))).drop("_rows")


def merge_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], required: str) -> DataFrame:
    """Left join to a side made unique on the keys; an unmatched row raises at run time."""
    side = right.groupBy(*keys).agg(F.min(required).alias(required))
    joined = left.join(side, list(keys), "left")
    return joined.withColumn(
        required,
        F.when(F.col(required).isNull(), F.raise_error(F.lit(f"no {required} for a row"))).otherwise(
            F.col(required)
        ),
    )


def keep_best_models(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """Predictions of the best model of each feature set.

    A feature set and a model are all of a join key, so a shuffle would send every prediction
    to a handful of tasks. The best models are one row per feature set and go to the rows.
    """
    return predictions.join(F.broadcast(best.select("FeatureSet", "Model")), ["FeatureSet", "Model"], "left_semi")


def assert_models_present(predictions: DataFrame, best: DataFrame) -> None:
    """Fail when a best model has no predictions; one small job."""
    missing = best.select("FeatureSet", "Model").join(predictions, ["FeatureSet", "Model"], "left_anti")
    example = missing.limit(1).collect()
    if example:
        raise ValueError(f"no predictions for {tuple(example[0])}")


def align_predictions(regression: DataFrame, classification: DataFrame) -> DataFrame:
    """Both out-of-fold tables on (Fold, FeatureSet, testId) with the predicted margin.

    The join is one to one: a test that a side has twice would be judged twice, so it raises.
    Rows of both sides meet in one aggregate by key, which also counts them; a window and a join
    would sort each side twice. A NULL in the key matches nothing.
    """
    keys = ["Fold", "FeatureSet", "testId"]
    left = regression.drop(M.FAILED, M.SCORE)
    right = classification.select(*keys, M.FAILED, M.SCORE)
    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    here = {c: F.col("_left") for c in left.columns if c not in keys} | {c: ~F.col("_left") for c in (M.FAILED, M.SCORE)}
    met = both.groupBy(*keys).agg(
        E.count_if(F.col("_left")).alias("_lefts"),
        E.count_if(~F.col("_left")).alias("_rights"),
        *[F.first(F.when(side, F.col(c)), ignorenulls=True).alias(c) for c, side in here.items()],
    )
    wrong = F.raise_error(F.lit(f"key {keys} is not unique"))
    known = F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull() & F.col(keys[2]).isNotNull()
    pair = F.when((F.col("_lefts") > 1) | (F.col("_rights") > 1), wrong).otherwise((F.col("_lefts") == 1) & (F.col("_rights") == 1) & known)
    return met.where(pair).drop("_lefts", "_rights").withColumn("PredictedMargin_psi", F.col(M.PREDICTED) - F.col("RequiredStrength28_psi"))


# --------------------------------------------------------------------------
# Threshold sweeps
# --------------------------------------------------------------------------
def grid_gap(score: Column, grid: Sequence[float], inclusive: bool) -> Column:
    """How many grid points lie below the score (or at it, with ``inclusive``).

    Nested halving keeps it to a handful of comparisons per row.
    """

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        beyond = score >= F.lit(grid[middle]) if inclusive else score > F.lit(grid[middle])
        return F.when(beyond, between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(grid))


def sweep(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    thresholds: Sequence[float],
    method: str,
    unit: str,
    at_most: bool,
    actual: str = M.FAILED,
) -> DataFrame:
    """Decision metrics at every threshold in one pass over the predictions.

    A prediction falls between two neighbouring thresholds. Counting rows per gap
    (combined map-side) and adding the counts up along the thresholds gives the same
    numbers as testing every row against every threshold.
    """
    grid = sorted(thresholds)
    gap = grid_gap(F.col(score), grid, inclusive=not at_most)
    counted = (
        df.where(F.col(score).isNotNull())
        .groupBy(*keys, gap.alias("_gap"))
        .agg(E.count_if(F.col(actual) == 1).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    )
    every_gap = (
        counted.select(*keys)
        .distinct()
        .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("_gap"))
        .withColumns({"_pos": F.lit(0).cast("long"), "_n": F.lit(0).cast("long")})
    )
    full = counted.unionByName(every_gap).groupBy(*keys, "_gap").agg(
        F.sum("_pos").alias("_pos"), F.sum("_n").alias("_n")
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def flagged(c: str) -> Column:
        running = F.sum(c).over(upto)
        return running if at_most else F.sum(c).over(group) - running

    tp, n = flagged("_pos"), flagged("_n")
    out = full.select(
        *keys,
        "_gap",
        tp.alias("TruePositives"),
        (n - tp).alias("FalsePositives"),
        (F.sum("_pos").over(group) - tp).alias("FalseNegatives"),
        (F.sum("_n").over(group) - F.sum("_pos").over(group) - (n - tp)).alias("TrueNegatives"),
    ).where(F.col("_gap") < len(grid))
    return out.withColumns(
        {
            "Method": F.lit(method),
            "Threshold": F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("_gap") + 1),
            "ThresholdUnit": F.lit(unit),
            **M.rates(F.col("TruePositives"), F.col("FalsePositives"), F.col("FalseNegatives")),
        }
    ).drop("_gap")


def full_sweep(aligned: DataFrame, keys: Sequence[str] = ("FeatureSet",)) -> DataFrame:
    """Margin and probability sweeps in one table."""
    aligned = shared(aligned)
    margin = sweep(aligned, keys, "PredictedMargin_psi", S.MARGIN_THRESHOLDS, "RegressionMargin", "psi", True)
    probability = sweep(aligned, keys, M.SCORE, S.PROBABILITY_THRESHOLDS, "DirectClassifier", "probability", False)
    return margin.unionByName(probability)


def best_at_recall(
    swept: DataFrame, keys: Sequence[str], targets: Sequence[float] = tuple(S.RECALL_TARGETS), by_threshold: bool = False
) -> DataFrame:
    """Most precise rule reaching each recall target.

    Ties go to fewer false positives, or to the higher threshold with ``by_threshold``.
    """
    wanted = swept.withColumn("MinimumRecallTarget", F.explode(F.array(*[F.lit(t) for t in targets])))
    eligible = wanted.where(F.col("Recall") >= F.col("MinimumRecallTarget"))
    tie = [F.desc("Threshold")] if by_threshold else [F.asc("FalsePositives"), F.asc("Threshold")]
    return top_rows(eligible, [*keys, "MinimumRecallTarget"], [F.desc("Precision"), *tie], 1)


def matched_recall(swept: DataFrame, targets: Sequence[float] = tuple(S.RECALL_TARGETS)) -> DataFrame:
    """Both methods side by side per feature set and recall target; empty targets stay."""
    keys = ["FeatureSet", "MinimumRecallTarget"]
    swept = shared(swept)
    best = best_at_recall(swept, ["FeatureSet", "Method"], targets)
    grid = swept.select("FeatureSet").distinct().withColumn(
        "MinimumRecallTarget", F.explode(F.array(*[F.lit(t) for t in targets]))
    )
    names = ["Threshold", "Recall", "Precision", "F1", "FalseNegatives", "FalsePositives"]
    first = {"RegressionMargin": "RegressionMarginThreshold_psi", "DirectClassifier": "ClassifierProbabilityThreshold"}
    prefix = {"RegressionMargin": "Regression", "DirectClassifier": "Classifier"}
    out = grid
    for method in first:
        side = best.where(F.col("Method") == method).select(
            *keys, *[F.col(n).alias(first[method] if n == "Threshold" else prefix[method] + n) for n in names]
        )
        out = out.join(side, keys, "left")
    return out.withColumns(
        {
            f"{short}Difference_ClassifierMinusRegression": F.col(f"Classifier{n}") - F.col(f"Regression{n}")
            for short, n in (
                ("Precision", "Precision"),
                ("FalsePositive", "FalsePositives"),
                ("FalseNegative", "FalseNegatives"),
            )
        }
    )


def best_f1(swept: DataFrame) -> DataFrame:
    order = [F.desc("F1"), F.desc("Precision"), F.asc("Threshold")]
    return top_rows(swept, ["FeatureSet", "Method"], order, 1)


def choose_threshold(df: DataFrame, keys: Sequence[str], min_recall: float = S.MIN_FAILURE_RECALL) -> DataFrame:
    """Score cut with the highest precision at the recall target, over all scores.

    Without any eligible cut the highest recall wins.
    """
    cuts = M.score_sums(df, keys).select(
        *keys,
        F.col(M.SCORE).alias("Threshold"),
        E.safe_div("pos_upto", "n_upto").alias("Precision"),
        F.coalesce(E.safe_div("pos_upto", "pos_total"), F.lit(0.0)).alias("Recall"),
    )
    reached = E.flag(F.col("Recall") >= min_recall)
    order = [
        F.desc("_ok"),
        F.desc(F.when(F.col("_ok") == 1, F.col("Precision")).otherwise(F.col("Recall"))),
        F.desc("Threshold"),
    ]
    return top_rows(cuts.withColumn("_ok", reached), keys, order, 1).drop("_ok")


# --------------------------------------------------------------------------
# Comparisons
# --------------------------------------------------------------------------
def compare_fixed(
    aligned: DataFrame, keys: Sequence[str] = ("FeatureSet",), margin: float = 0.5, probability: float = 0.5, strict_failure: bool = False
) -> DataFrame:
    """Regression rule and classifier at fixed thresholds in one aggregate.

    The regression rule is margin <= ``margin``, or predicted < required with
    ``strict_failure``.
    """
    alert = F.col("PredictedMargin_psi") < 0 if strict_failure else F.col("PredictedMargin_psi") <= margin
    flagged = aligned.withColumns(
        {"RegressionRiskFlag": E.flag(alert), "ClassifierRiskFlag": E.flag(F.col(M.SCORE) >= probability)}
    )
    aggs, outs = [], {}
    for side in ("Regression", "Classifier"):
        counts = M.confusion(F.col(M.FAILED), F.col(f"{side}RiskFlag"))
        aggs += [c.alias(f"{side}{n}") for n, c in counts.items()]
        named = {n: F.col(f"{side}{n}") for n in counts}
        outs |= {
            f"{side}{n}": c
            for n, c in M.rates(named["TruePositives"], named["FalsePositives"], named["FalseNegatives"]).items()
        }
    out = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("Rows"), *aggs).withColumns(outs)
    return out.withColumns(
        {f"{n}Difference": F.col(f"Classifier{n}") - F.col(f"Regression{n}") for n in ("Recall", "Precision", "F1")}
    )


def risk_flags(aligned: DataFrame, probability: float = 0.5) -> DataFrame:
    """0/1 decisions of both methods on the aligned rows."""
    return aligned.withColumns(
        {
            "RegressionDerivedFailure": E.flag(F.col("PredictedMargin_psi") < 0),
            "ClassifierFailure": E.flag(F.col(M.SCORE) >= probability),
        }
    )


def best_model(summary: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key of a summary; ties go to the model name."""
    return top_rows(summary, keys, [*order, F.col("Model")], 1)


def improvement(
    summary: DataFrame, on: Sequence[str], variant: str, before: str, after: str, metrics: Sequence[str], lower_is_better: Sequence[str]
) -> DataFrame:
    """Two variants of a summary side by side with the improvement of each metric.

    Each variant occurs once per ``on`` key, so a conditional aggregate lines them up.
    """

    def at(name: str, metric: str) -> Column:
        return F.max(F.when(F.col(variant) == name, F.col(metric)))

    both = summary.where(F.col(variant).isin(before, after)).groupBy(*on).agg(
        *[at(before, m).alias(f"Before_{m}") for m in metrics],
        *[at(after, m).alias(f"After_{m}") for m in metrics],
        F.count_distinct(variant).alias("_variants"),
    )
    gains = {
        f"{m}_Improvement": (
            F.col(f"Before_{m}") - F.col(f"After_{m}") if m in lower_is_better else F.col(f"After_{m}") - F.col(f"Before_{m}")
        )
        for m in metrics
    }
    return (
        both.where(F.col("_variants") == 2)
        .drop("_variants")
        .withColumns({**gains, "BeforeVariant": F.lit(before), "AfterVariant": F.lit(after)})
    )


def tradeoff_view(swept: DataFrame, best: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Sweep rows of the best models at chosen thresholds."""
    return keep_best_models(swept, best).where(F.col("Threshold").isin(*[float(t) for t in thresholds]))


def precision_recall_series(swept: DataFrame) -> DataFrame:
    return swept.where(F.col("Method") == "DirectClassifier").select("FeatureSet", "Threshold", "Recall", "Precision")


def common_rows(predictions: DataFrame, variant: str, on: Sequence[str], key: str = "testId") -> DataFrame:
    """Rows whose key every variant has predicted, per ``on``: several runs on identical rows.

    Variants are counted per key with a map-side combine and the counts joined back.
    """
    wanted = predictions.select(*on, variant).distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("_wanted"))
    found = predictions.groupBy(*on, key).agg(F.count_distinct(variant).alias("_found"))
    complete = found.join(wanted, list(on)).where(F.col("_found") == F.col("_wanted")).select(*on, key)
    return predictions.join(complete, [*on, key], "left_semi")


def experiment_results(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error metrics and the distribution of the target per experiment.

    Six passes read the predictions, so they are kept, with no more than the columns of the metrics.
    """
    predictions = shared(predictions.select(*keys, M.ACTUAL, M.PREDICTED))
    target = {"TargetP01": 0.01, "TargetP50": 0.5, "TargetP99": 0.99}
    summary = predictions.groupBy(*keys).agg(
        F.avg(M.ACTUAL).alias("TargetMean"), F.stddev_pop(M.ACTUAL).alias("TargetStd"), F.min(M.ACTUAL).alias("TargetMin"), F.max(M.ACTUAL).alias("TargetMax")
    )
    spread = selected_quantiles(predictions, keys, M.ACTUAL, target)
    return M.regression_metrics(predictions, keys).join(summary, list(keys)).join(spread, list(keys))


def effects(results: DataFrame, variant: str, steps: Sequence[tuple[str, str, str]], on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Named steps (effect, before, after) between variants with both values of every metric.

    Each step needs exactly one row per variant and ``on`` key; anything else raises when the
    table is read. One aggregate over the short table of results.
    """
    every = F.array(*[F.struct(F.lit(e).alias("Effect"), F.lit(b).alias("BeforeVariant"), F.lit(a).alias("AfterVariant")) for e, b, a in steps])
    long = results.withColumn("_step", F.explode(every)).select("*", "_step.*").where(
        (F.col(variant) == F.col("BeforeVariant")) | (F.col(variant) == F.col("AfterVariant"))
    )
    before, after = F.col(variant) == F.col("BeforeVariant"), F.col(variant) == F.col("AfterVariant")
    out = long.groupBy(*on, "Effect", "BeforeVariant", "AfterVariant").agg(
        *[F.max(F.when(before, F.col(v))).alias(f"Before_{v}") for v in values],
        *[F.max(F.when(after, F.col(v))).alias(f"After_{v}") for v in values],
        E.count_if(before).alias("_before"),
        E.count_if(after).alias("_after"),
    )
    single = (F.col("_before") == 1) & (F.col("_after") == 1)
    wrong = F.raise_error(F.concat(F.lit("expected one result on both sides of "), F.col("Effect")))
    return out.withColumn("Effect", F.when(single, F.col("Effect")).otherwise(wrong)).drop("_before", "_after")


def r2_decomposition(results: DataFrame, steps: Sequence[tuple[str, str, str]] = tuple(S.R2_STEPS), variant: str = "Experiment") -> DataFrame:
    """What cohort, re-splitting and added features each do to R2 and MAE, per model."""
    table = effects(results, variant, steps, ["Model"], ["RowCount", "R2", "MAE", "TargetStd"])
    return table.withColumns(
        {"R2_Change": F.col("After_R2") - F.col("Before_R2"), "MAE_Improvement": F.col("Before_MAE") - F.col("After_MAE")}
    )


def context_impact(best: DataFrame, pairs: Mapping[str, tuple[str, str]] = S.CONTEXT_PAIRS) -> DataFrame:
    """Best model without and with context per stage; a stage without both feature sets is left out."""
    values = ["MeanCV_MAE", "MeanCV_RMSE", "MeanCV_R2"]
    present = F.col("FeatureSet").isin(*[name for pair in pairs.values() for name in pair])
    steps = [(stage, *pair) for stage, pair in pairs.items()]
    known = best.where(present)
    sides = known.withColumn("_stage", F.explode(F.array(*[
        F.struct(F.lit(s).alias("Stage"), F.lit(a).alias("a"), F.lit(b).alias("b")) for s, a, b in steps
    ]))).where((F.col("FeatureSet") == F.col("_stage.a")) | (F.col("FeatureSet") == F.col("_stage.b")))
    plain, full = F.col("FeatureSet") == F.col("_stage.a"), F.col("FeatureSet") == F.col("_stage.b")
    names = {"MeanCV_MAE": "MAE", "MeanCV_RMSE": "RMSE", "MeanCV_R2": "R2"}
    out = sides.groupBy(F.col("_stage.Stage").alias("Stage")).agg(
        *[F.max(F.when(plain, F.col(v))).alias(f"WithoutContext_{names[v]}") for v in values],
        *[F.max(F.when(full, F.col(v))).alias(f"WithContext_{names[v]}") for v in values],
        F.count_distinct("FeatureSet").alias("_sides"),
    ).where("_sides = 2").drop("_sides")
    return out.withColumns(
        {
            "MAE_ImprovementPsi": F.col("WithoutContext_MAE") - F.col("WithContext_MAE"),
            "RMSE_ImprovementPsi": F.col("WithoutContext_RMSE") - F.col("WithContext_RMSE"),
            "R2_Improvement": F.col("WithContext_R2") - F.col("WithoutContext_R2"),
        }
    )


def controlled_improvement(predictions: DataFrame, before: str, after: str, variant: str = "FeatureSet") -> DataFrame:
    """Mean fold R2 and MAE of two feature sets on identical rows and folds, per model, best first."""
    pair = predictions.where(F.col(variant).isin(before, after))
    same = common_rows(pair, variant, ["Model"])
    folds = M.regression_metrics(same, [variant, "Model", "Fold"], quantiles=False)
    means = folds.groupBy(variant, "Model").agg(F.avg("R2").alias("Mean_R2"), F.avg("MAE").alias("Mean_MAE"))
    table = effects(means, variant, [("Controlled", before, after)], ["Model"], ["Mean_R2", "Mean_MAE"]).drop("Effect")
    out = table.withColumns(
        {"Mean_R2_Change": F.col("After_Mean_R2") - F.col("Before_Mean_R2"), "Mean_MAE_Improvement": F.col("Before_Mean_MAE") - F.col("After_Mean_MAE")}
    )
    return out.orderBy("After_Mean_MAE", "Model")
