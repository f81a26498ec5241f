"""Validation on rows from outside: later years, and suppliers or mixes never seen in training.

A scenario gives every row a role; a stage says which features are known and which rows count.
Every (scenario, stage, task) is fitted on its own rows: a stage before the seventh day keeps
tests without a seven-day strength.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import boost as B
from pourstat.operators import encode as N
from pourstat.operators import grid as G
from pourstat.operators import metrics as M
from pourstat.operators import models as L
from pourstat.operators import splits as P
from pourstat.operators.clean import with_day7
from pourstat.session import durable, stored

UNSEEN = ("UnseenSupplier", "UnseenSupplierPlantMix")


@dataclass(frozen=True)
class Stage:
    """Features known at a time, and whether a seven-day strength is needed."""

    name: str
    features: tuple[str, ...]
    needs_day7: bool


def stages() -> list[Stage]:
    context = L.context_features()
    return [
        Stage("Day0_Context", (*S.DAY0_FEATURES, *context), False),
        Stage("Day7_FullUpdated", (*S.DAY0_FEATURES, *context, *S.DAY7_FEATURES), True),
    ]


def labelled_rows(facts: DataFrame) -> DataFrame:
    """Tests with strength and requirement, their failure flag, seven-day features, context and group."""
    rows = with_day7(facts).where((F.col(S.TARGET) > 0) & (F.col(S.REQUIRED) > 0))
    rows = rows.withColumns(
        {S.FAILURE: E.failure(S.TARGET, S.REQUIRED), "SplitGroup": E.project_group("projectId", "testId")}
    )
    return N.with_context(rows, "SupplierName", "plantNumber", "mixNumber")


def scenario_rows(facts: DataFrame) -> DataFrame:
    """The columns of labelled rows that roles, stages and models use, stored: every scenario, stage and task reads them."""
    names = [*S.DAY0_FEATURES, *S.DAY7_FEATURES, S.TARGET, S.REQUIRED, S.FAILURE, "testId", "castDate", "SplitGroup", *N.CONTEXT]
    return stored(labelled_rows(facts).select(*dict.fromkeys(names)))


def external_roles(rows: DataFrame, train_until: int, first: int, last: int) -> DataFrame:
    """Training rows up to a year and test rows of later years; a test id on both sides raises."""
    year = F.year("castDate")
    role = F.when(year <= train_until, F.lit("train")).when(year.between(first, last), F.lit("test"))
    out = rows.withColumns({"Role": role, "ExternalValidationYear": year}).where(F.col("Role").isNotNull())
    P.assert_disjoint(out.where("Role = 'train'"), out.where("Role = 'test'"), "testId")
    return out


def unseen_roles(rows: DataFrame, scenario: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Rows with known context; whole groups of the scenario are held out."""
    split = P.train_test(P.scenario_rows(rows, scenario), "ScenarioGroup", test_percent, seed)
    return split.withColumn("Role", F.col("DatasetSplit"))


def split_summary(rows: DataFrame, roles: DataFrame, scenario: str) -> DataFrame:
    """Rows before and after the context filter, rows and groups of both sides, shared groups; one row."""
    before = rows.agg(F.count(F.lit(1)))
    groups = roles.groupBy("ScenarioGroup").agg(
        E.count_if(F.col("Role") == "train").alias("train"), E.count_if(F.col("Role") == "test").alias("test")
    )
    out = groups.agg(
        F.coalesce(F.sum(F.col("train") + F.col("test")), F.lit(0)).alias("RowsAfterContextFilter"),
        F.coalesce(F.sum("train"), F.lit(0)).alias("TrainRows"),
        F.coalesce(F.sum("test"), F.lit(0)).alias("TestRows"),
        E.count_if(F.col("train") > 0).alias("TrainGroups"),
        E.count_if(F.col("test") > 0).alias("TestGroups"),
        E.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("OverlappingGroups"),
    ).withColumn("RowsBeforeContextFilter", before.scalar())
    excluded = F.col("RowsBeforeContextFilter") - F.col("RowsAfterContextFilter")
    return out.withColumns({"RowsExcludedForMissingContext": excluded, "Scenario": F.lit(scenario)})


def _of_stage(rows: DataFrame, stage: Stage) -> DataFrame:
    return rows.where(F.col("Day7AverageStrength_psi") > 0) if stage.needs_day7 else rows


def frames(rows: DataFrame, keep: Sequence[str] = (), of: Sequence[Stage] | None = None) -> dict[str, G.Frame]:
    """The model frame of every stage with the encodings of both tasks, which ``evaluate`` then shares."""
    return {
        stage.name: G.pack_holdout(_of_stage(rows, stage), {stage.name: list(stage.features)}, (S.TARGET, S.FAILURE), extra=keep)
        for stage in of or stages()
    }


def _holdout(
    rows: DataFrame, stage: Stage, classify: bool, keep: Sequence[str], boosting: B.BoostParams | None, packed: G.Frame | None
) -> DataFrame:
    rows = _of_stage(rows, stage)
    sets = {stage.name: list(stage.features)}
    label = S.FAILURE if classify else S.TARGET
    f = G.pack_holdout(rows, sets, label=label, extra=keep) if packed is None else packed.encoded_by(label)
    models = G.fit_logistic(f, sets) if classify else G.fit_regressions(f, sets, {"Ridge": G.RIDGE_PENALTY})
    out = G.predict(f, models, classify).drop("Fold")
    if boosting is not None:
        encoded = durable(L.holdout_rows(rows, sets, label, keep))
        weighted = N.class_weights(encoded.where("Role = 'train'"), label).select("testId", "ClassWeight") if classify else None
        if weighted is not None:
            encoded = encoded.join(weighted, "testId", "left").withColumn("ClassWeight", F.coalesce("ClassWeight", F.lit(1.0)))
        scores, _, _ = B.boost(encoded, sets, label, boosting, classify, weight="ClassWeight" if classify else None)
        value = M.SCORE if classify else M.PREDICTED
        actual = M.FAILED if classify else M.ACTUAL
        head = encoded.select("testId", F.col(S.REQUIRED).cast("double").alias("RequiredStrength28_psi"), *keep)
        own = scores.select(
            "testId", "FeatureSet", F.lit("HistGradientBoosting").alias("Model"),
            F.col("y").cast("int" if classify else "double").alias(actual), F.col("Score").alias(value),
        )
        out = out.unionByName(own.join(head, "testId"))
    return out.withColumnRenamed("FeatureSet", "Stage")


def evaluate(
    rows: DataFrame,
    classify: bool,
    keep: Sequence[str] = (),
    boosting: B.BoostParams | None = None,
    of: Sequence[Stage] | None = None,
    packed: Mapping[str, G.Frame] | None = None,
) -> DataFrame:
    """Test predictions of all stages and models for rows that carry ``Role``.

    Regression has the mean, the median and ridge, classification the prior and balanced
    logistic regression; with ``boosting`` both have leaf-wise boosting too. ``packed`` has the
    ``frames`` of the same rows, columns and stages where both tasks are evaluated.
    """
    out: DataFrame | None = None
    for stage in of or stages():
        part = _holdout(rows, stage, classify, keep, boosting, packed[stage.name] if packed else None)
        out = part if out is None else out.unionByName(part)
    return out


def metrics(predictions: DataFrame, classify: bool, keys: Sequence[str]) -> DataFrame:
    """Error or decision metrics (at 0.5) per key."""
    return M.classification_metrics(predictions, keys) if classify else M.regression_metrics(predictions, keys)
