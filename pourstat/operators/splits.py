"""Group-disjoint splits and folds.

A group is assigned by a hash of its key or by its place in the table of group
sizes, so all rows of a group land on the same side by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators.order_stats import spread_row_number


def percent_bucket(group: Column | str, seed: int) -> Column:
    """Bucket 0..99 of a group key, fixed by the seed."""
    text = F.concat(F.lit(f"{seed}|"), E.col(group).cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100).cast("int")


def train_test(df: DataFrame, group: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """``DatasetSplit`` of train or test; the share is of groups."""
    return df.withColumn(
        "DatasetSplit",
        F.when(percent_bucket(group, seed) < test_percent, F.lit("test")).otherwise(F.lit("train")),
    )


def train_validation_test(
    df: DataFrame, group: str, test_percent: int = 20, validation_percent: int = 20, seed: int = 42
) -> DataFrame:
    """Test groups first, then validation groups from the rest with the next seed."""
    return df.withColumn(
        "DatasetSplit",
        F.when(percent_bucket(group, seed) < test_percent, F.lit("test"))
        .when(percent_bucket(group, seed + 1) < validation_percent, F.lit("validation"))
        .otherwise(F.lit("train")),
    )


def _dealt(sizes: DataFrame, keys: Sequence[str], group: str, folds: int, name: str) -> DataFrame:
    """Fold of every group: group sizes inside ``keys`` are dealt out back and forth.

    Ordering runs on the table of group sizes and is spread over (size, hash prefix).
    """
    sizes = sizes.withColumn("_hash", F.md5(F.col(group).cast("string")))
    sizes = sizes.withColumn("_prefix", F.substring("_hash", 1, 3))
    placed = spread_row_number(
        sizes, keys, [("_size", False), ("_prefix", True)], [F.col("_hash"), F.col(group)], "_place"
    )
    if keys:
        groups = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_groups"))
        placed = placed.join(groups, list(keys))
    else:
        placed = placed.withColumn("_groups", sizes.agg(F.count(F.lit(1))).scalar())
    placed = placed.withColumn("_k", F.least(F.lit(folds), F.col("_groups")))
    at = F.col("_place") - 1
    turn, slot = F.floor(at / F.col("_k")), at % F.col("_k")
    fold = F.when(turn % 2 == 0, slot + 1).otherwise(F.col("_k") - slot).cast("int")
    checked = F.when(F.col("_k") < 2, F.raise_error(F.lit("at least two groups are required"))).otherwise(fold)
    return placed.withColumn(name, checked).drop("_hash", "_prefix", "_place", "_groups", "_k")


def group_folds(df: DataFrame, group: str, folds: int = 5, name: str = "Fold") -> DataFrame:
    """Fold per group, balanced by rows."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    return _dealt(sizes, [], group, folds, name).drop("_size")


def with_folds(df: DataFrame, group: str, folds: int = 5, name: str = "Fold") -> DataFrame:
    return df.join(group_folds(df, group, folds, name), group)


def nested_group_folds(df: DataFrame, group: str, outer: int = 5, inner: int = 5) -> DataFrame:
    """Outer fold per group, and its inner fold inside the training side of every other outer fold.

    ``InnerFolds`` has one place per outer fold: the groups outside that fold are dealt out
    anew among themselves, so each training side has folds of its own. The place of the own
    outer fold is NULL. Only the table of group sizes is multiplied, by the number of folds.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    placed = _dealt(sizes, [], group, outer, "Fold")
    others = F.filter(F.sequence(F.lit(1), F.lit(outer)), lambda o: o != F.col("Fold"))
    sides = placed.select(group, "_size", F.explode(others).alias("_outer"))
    inner_folds = _dealt(sides, ["_outer"], group, inner, "_inner")
    of_group = inner_folds.groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct("_outer", "_inner"))).alias("_by_outer")
    )
    places = F.transform(F.sequence(F.lit(1), F.lit(outer)), lambda o: F.try_element_at("_by_outer", o))
    return placed.join(of_group, group).select(group, "Fold", places.alias("InnerFolds"))


def with_nested_folds(df: DataFrame, group: str, outer: int = 5, inner: int = 5) -> DataFrame:
    return df.join(nested_group_folds(df, group, outer, inner), group)


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that occur on both sides."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def assert_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """Fail when both sides share a key; runs one job that stops at the first hit."""
    example = shared_keys(left, right, key).limit(1).collect()
    if example:
        raise ValueError(f"{key} {example[0][0]!r} is on both sides")


def group_membership(df: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Rows of each group per split or fold."""
    return df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("RowCount"))


def scenario_rows(df: DataFrame, scenario: str) -> DataFrame:
    """Rows with known context and the group of an unseen-group scenario."""
    missing = S.MISSING_CATEGORY
    if scenario == "UnseenSupplier":
        rows, group = df.where(F.col("SupplierCategory") != missing), "SupplierCategory"
    elif scenario == "UnseenSupplierPlantMix":
        rows = df.where(
            (F.col("SupplierCategory") != missing)
            & (F.col("PlantCategory") != missing)
            & (F.col("MixCategory") != missing)
        )
        group = "SupplierPlantMixCategory"
    else:
        raise ValueError(f"unknown scenario {scenario}")
    return rows.withColumn("ScenarioGroup", F.col(group))


def fold_roles(df: DataFrame, fold: int, name: str = "Fold") -> DataFrame:
    """``Role`` of every row for one outer fold."""
    return df.withColumn("Role", F.when(F.col(name) == fold, F.lit("test")).otherwise(F.lit("train")))


def cohorts(df: DataFrame, field: Sequence[str], batch: Sequence[str]) -> DataFrame:
    """Flags of the strength cohort and of the complete-case cohort."""
    complete = F.lit(True)
    for c in [S.TARGET, "projectId", *field, *batch]:
        complete = complete & F.col(c).isNotNull()
    return df.withColumns(
        {"AllStrength": E.flag(F.col(S.TARGET).isNotNull()), "CompleteCase": E.flag(complete)}
    )
