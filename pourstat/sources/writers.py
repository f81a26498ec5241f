"""Writing: CSV, Parquet, run records, session tables and fitted models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from pourstat.session import shared


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with header, overwriting the target."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "quoteAll", quote_all
    ).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, overwriting the target; partition large facts by year or feature set."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_run_record(record: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    record.coalesce(1).write.mode("overwrite").json(path)


def keep_as_view(df: DataFrame, name: str) -> DataFrame:
    """Persisted intermediate result under a session-wide name, replacing an older one."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        spark.catalog.uncacheTable(name)
    kept = shared(df)
    kept.createOrReplaceTempView(name)
    return kept


def save_model(model: PipelineModel, path: str, features: Sequence[str], metadata: Mapping[str, object]) -> None:
    """Fitted pipeline with its feature list and metadata beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    row = {k: str(v) for k, v in metadata.items()} | {"features": ",".join(features)}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def keep_best_model(spark: SparkSession, folder: str, metrics: DataFrame, name: str = "best_holdout_model") -> tuple[str, str]:
    """Copy the best of the saved models to a fixed name; returns its feature set and model name.

    Models lie at ``folder/<FeatureSet>__<Model>``; the lowest MAE wins, then the lowest RMSE,
    then the names. One row of ``metrics`` reaches the driver.
    """
    best = metrics.orderBy("MAE", "RMSE", "FeatureSet", "Model").select("FeatureSet", "Model").first()
    if best is None:
        raise ValueError("no model to choose from")
    model, row = load_model(spark, f"{folder}/{best.FeatureSet}__{best.Model}")
    metadata = {k: v for k, v in row.items() if k != "features"} | {"feature_set": best.FeatureSet, "model_name": best.Model}
    save_model(model, f"{folder}/{name}", row["features"].split(","), metadata)
    return best.FeatureSet, best.Model


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, str]]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metadata").first().asDict()


def model_parameters(models: Mapping[str, object]) -> DataFrame:
    """Every parameter of every estimator as (Model, Parameter, Value) rows."""
    rows = []
    for name, stage in models.items():
        for param in stage.params:
            if stage.isDefined(param):
                rows.append((name, param.name, str(stage.getOrDefault(param))))
    return SparkSession.getActiveSession().createDataFrame(rows, "Model string, Parameter string, Value string")
