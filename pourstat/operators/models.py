"""Strength regressors and failure classifiers on Spark ML.

Only fitting loops on the driver. Rows stay distributed; what reaches the driver is
one row of fitted medians and counts per feature list.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import encode as N
from pourstat.operators import metrics as M
from pourstat.operators.clean import with_day7
from pourstat.operators.order_stats import selected_quantiles, unpivot
from pourstat.operators.splits import fold_roles, group_folds, with_nested_folds
from pourstat.session import durable, shared

LABEL, WEIGHT = "_label", "ClassWeight"
RAW, SCALED = "_raw", "_scaled"


@dataclass(frozen=True)
class Size:
    """Ensemble sizes; the defaults follow the usual experiment settings."""

    trees: int = 300
    rounds: int = 300
    depth: int = 12
    seed: int = 42


@dataclass(frozen=True)
class Spec:
    """How to build an estimator from the train row count and label deviation."""

    build: Callable[[int, float], Estimator] | None
    scaled: bool = False
    params: Mapping[str, object] = field(default_factory=dict)


def regressors(size: Size = Size()) -> dict[str, Spec]:
    """Mean baseline, least squares, ridge, random forest and gradient boosting."""
    return {
        "DummyMean": Spec(None),
        "LinearRegression": Spec(lambda n, sd: LinearRegression(featuresCol="features", labelCol=LABEL), scaled=True),
        # Spark ML averages the loss over rows and divides the penalty by the label
        # deviation; this value restores a penalty of 10 on the squared weights.
        "Ridge": Spec(
            lambda n, sd: LinearRegression(
                featuresCol="features", labelCol=LABEL, regParam=10.0 / n * sd, elasticNetParam=0.0, standardization=False
            ),
            scaled=True,
        ),
        "RandomForest": Spec(
            lambda n, sd: RandomForestRegressor(
                featuresCol="features",
                labelCol=LABEL,
                numTrees=size.trees,
                maxDepth=size.depth,
                minInstancesPerNode=5,
                featureSubsetStrategy="0.8",
                seed=size.seed,
            )
        ),
        "GradientBoosting": Spec(
            lambda n, sd: GBTRegressor(
                featuresCol="features",
                labelCol=LABEL,
                maxIter=size.rounds,
                stepSize=0.05,
                maxDepth=5,
                minInstancesPerNode=20,
                subsamplingRate=0.85,
                seed=size.seed,
            )
        ),
    }


def classifiers(size: Size = Size()) -> dict[str, Spec]:
    """Prior baseline and class-weighted logistic regression, forest and boosting."""
    return {
        "DummyPrior": Spec(None),
        "LogisticRegression": Spec(
            lambda n, sd: LogisticRegression(
                featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, regParam=1.0 / n, maxIter=200
            ),
            scaled=True,
        ),
        "RandomForest": Spec(
            lambda n, sd: RandomForestClassifier(
                featuresCol="features",
                labelCol=LABEL,
                weightCol=WEIGHT,
                numTrees=size.trees,
                maxDepth=size.depth,
                minInstancesPerNode=5,
                featureSubsetStrategy="0.8",
                seed=size.seed,
            )
        ),
        "GradientBoosting": Spec(
            lambda n, sd: GBTClassifier(
                featuresCol="features",
                labelCol=LABEL,
                weightCol=WEIGHT,
                maxIter=size.rounds,
                stepSize=0.05,
                maxDepth=5,
                minInstancesPerNode=20,
                subsamplingRate=0.85,
                seed=size.seed,
            )
        ),
    }


# --------------------------------------------------------------------------
# One split
# --------------------------------------------------------------------------
def impute_fitted(df: DataFrame, features: Sequence[str], role: str = "Role") -> tuple[DataFrame, list[str], tuple[int, float]]:
    """Train medians filled in as constants, with indicators where train values miss.

    Returns the frame, the model columns and the train row count with the label deviation. Columns that
    are empty or constant on the train rows carry nothing and are left out.
    """
    train = df.where(F.col(role) == "train")
    counts = train.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.coalesce(F.stddev_pop(LABEL), F.lit(0.0)).alias("_deviation"),
        *[F.count(c).alias(c) for c in features],
        *[(F.min(c) < F.max(c)).alias(f"{c}_varies") for c in features],
    ).first()
    long = unpivot(train, [], features)
    medians = {r["Column"]: r["m"] for r in selected_quantiles(long, ["Column"], "Value", {"m": 0.5}).collect()}
    known = [c for c in features if medians.get(c) is not None]
    indicators = [c for c in known if counts[c] < counts["_rows"]]
    used = [c for c in known if counts[f"{c}_varies"]]
    cols: dict[str, Column] = {f"{c}_WasMissing": E.flag(F.col(c).isNull()) for c in indicators}
    cols |= {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in known}
    return df.withColumns(cols), [*used, *[f"{c}_WasMissing" for c in indicators]], (counts["_rows"], counts["_deviation"])


def vectors(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The kept columns and the model columns as one vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=RAW).transform(df).select(*dict.fromkeys(keep), RAW)


def evaluate_split(
    df: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    specs: Mapping[str, Spec],
    label: str,
    keep: Sequence[str],
    classify: bool = False,
    role: str = "Role",
    kept: list[DataFrame] | None = None,
) -> DataFrame:
    """Test-row predictions of every model on every feature set of one split.

    Persisted train frames are added to ``kept`` so that the caller can release them
    once the predictions are stored.
    """
    output = M.SCORE if classify else M.PREDICTED
    out: DataFrame | None = None
    for name, features in feature_sets.items():
        leaks = sorted(set(features) & set(S.LEAKAGE_COLUMNS))
        if leaks:
            raise ValueError(f"{name} contains leakage columns: {leaks}")
        rows, columns, n = impute_fitted(df.withColumn(LABEL, F.col(label).cast("double")), features, role)
        train, test = rows.where(F.col(role) == "train"), rows.where(F.col(role) == "test")
        train = N.class_weights(train, LABEL) if classify else train
        # All models read the same vectors, scaled once for those that ask for it.
        train = shared(vectors(train, columns, [LABEL, *([WEIGHT] if classify else [])]))
        scored = vectors(test, columns, [*keep, LABEL])
        if kept is not None:
            kept.append(train)
        fitting = train
        if any(spec.scaled for spec in specs.values()):
            scaler = StandardScaler(inputCol=RAW, outputCol=SCALED, withMean=True, withStd=True).fit(train)
            fitting, scored = scaler.transform(train), scaler.transform(scored)
        scores: dict[str, str] = {}
        for model_name, spec in specs.items():
            scores[model_name] = f"_score{len(scores)}"
            if spec.build is None:
                value = train.agg(F.avg(LABEL)).scalar()
            else:
                of = SCALED if spec.scaled else RAW
                model = spec.build(*n).fit(fitting.withColumn("features", F.col(of)))
                scored = model.transform(scored.withColumn("features", F.col(of)))
                value = vector_to_array(F.col("probability"))[1] if classify else F.col("prediction")
            scored = scored.withColumn(scores[model_name], value).drop("features", "rawPrediction", "probability", "prediction")
        # The test rows are read once; every row then becomes one row per model.
        models = F.array(*[F.struct(F.lit(m).alias("Model"), F.col(c).alias(output)) for m, c in scores.items()])
        part = scored.select(
            *keep,
            F.lit(name).alias("FeatureSet"),
            F.col(LABEL).cast("int" if classify else "double").alias(M.FAILED if classify else M.ACTUAL),
            F.explode(models).alias("_model"),
        ).select(*keep, "FeatureSet", "_model.Model", M.FAILED if classify else M.ACTUAL, f"_model.{output}")
        out = part if out is None else out.unionByName(part)
    return out


# --------------------------------------------------------------------------
# Experiments
# --------------------------------------------------------------------------
def context_features(columns: Sequence[str] = tuple(N.CONTEXT)) -> list[str]:
    return [f"{c}_{n}" for c in columns for n in ("TargetMean", "LogCount", "Unknown")]


def four_feature_sets() -> dict[str, list[str]]:
    """Field, context and day-7 information in four combinations."""
    context = context_features()
    return {
        "Day0_FieldPlusRequired": S.DAY0_FEATURES,
        "Day0_Context": S.DAY0_FEATURES + context,
        "Day7_FieldPlusRequired": S.DAY0_FEATURES + S.DAY7_FEATURES,
        "Full_ContextPlusDay7": S.DAY0_FEATURES + context + S.DAY7_FEATURES,
    }


def experiment_rows(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Rows with target, requirement and day-7 strength, their context, fold and inner folds."""
    rows = with_day7(df).where(
        (F.col(S.TARGET) > 0) & (F.col(S.REQUIRED) > 0) & (F.col("Day7AverageStrength_psi") > 0)
    )
    rows = rows.withColumn(S.FAILURE, E.failure(S.TARGET, S.REQUIRED))
    return N.with_context(with_nested_folds(rows, group, folds), "SupplierName", "plantNumber", "mixNumber")


def model_columns(feature_sets: Mapping[str, Sequence[str]]) -> list[str]:
    """Plain input columns of the feature sets, requirement included."""
    context = set(context_features())
    names = [c for f in feature_sets.values() for c in f if c not in context]
    return list(dict.fromkeys([*names, S.REQUIRED]))


def cross_validate(
    rows: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    specs: Mapping[str, Spec],
    folds: int = 5,
    classify: bool = False,
) -> DataFrame:
    """Out-of-fold predictions over all folds, feature sets and models.

    Context is encoded inside each outer fold, from the inner folds of its own training side;
    the sums of all folds come from one cube and are attached to the rows once. The narrow
    model frame is written once because every fold and model reads it; predictions of a fold
    are checkpointed before the next fold starts. Linear models have a joint way in ``grid``.
    """
    label = S.FAILURE if classify else S.TARGET
    needs_context = any(set(f) & set(context_features()) for f in feature_sets.values())
    rows = durable(rows.select(*model_columns(feature_sets), "Fold", "InnerFolds", "testId", S.TARGET, S.FAILURE, *N.CONTEXT))
    if needs_context:
        cube = durable(N.context_cube(rows, N.CONTEXT, label))
        priors = N.fold_priors(cube, N.CONTEXT[0])
        rows = durable(N.with_context_cells(rows, N.CONTEXT, cube))
    out: DataFrame | None = None
    for k in range(1, folds + 1):
        split, kept = fold_roles(rows, k), []
        if needs_context:
            split = split.withColumns(N.fold_encodings(N.CONTEXT, k, priors[k]))
        part = durable(
            evaluate_split(split, feature_sets, specs, label, ["Fold", "testId", S.REQUIRED], classify, kept=kept)
        )
        for frame in kept:
            frame.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed(S.REQUIRED, "RequiredStrength28_psi")


def holdout(
    rows: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    specs: Mapping[str, Spec],
    classify: bool = False,
    extra: Sequence[str] = (),
    group: str = "SplitGroup",
    inner: int = 5,
) -> DataFrame:
    """Predictions on the test rows of a frame that carries ``Role``.

    Context of the train rows is encoded over folds of their own groups.
    """
    label = S.FAILURE if classify else S.TARGET
    rows = shared(holdout_rows(rows, feature_sets, label, extra, group, inner))
    kept: list[DataFrame] = [rows]
    out = durable(evaluate_split(rows, feature_sets, specs, label, ["testId", *extra], classify, kept=kept))
    for frame in kept:
        frame.unpersist()
    return out


def holdout_rows(
    rows: DataFrame, feature_sets: Mapping[str, Sequence[str]], label: str, extra: Sequence[str] = (), group: str = "SplitGroup", inner: int = 5
) -> DataFrame:
    """The columns of a holdout, with encoded context where a feature set asks for it."""
    needs_context = any(set(f) & set(context_features()) for f in feature_sets.values())
    named = [*model_columns(feature_sets), "Role", "testId", S.TARGET, S.FAILURE, group, *(N.CONTEXT if needs_context else [])]
    rows = durable(rows.select(*dict.fromkeys([*named, *extra])))
    if not needs_context:
        return rows
    folds = group_folds(rows.where(F.col("Role") == "train"), group, inner, "_within")
    return N.cross_fitted_encode(rows.join(folds, group, "left"), N.CONTEXT, label, "_within").drop("_within")
