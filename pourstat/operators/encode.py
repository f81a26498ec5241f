"""Leakage-safe context encoding and exact train-only preprocessing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators.order_stats import join_on, selected_quantiles, unpivot
from pourstat.session import stored

CONTEXT = [
    "SupplierCategory",
    "PlantCategory",
    "MixCategory",
    "SupplierPlantCategory",
    "SupplierPlantMixCategory",
]
SMOOTHING = 20.0


def with_context(df: DataFrame, supplier: str, plant: str, mix: str, subtype: str | None = None) -> DataFrame:
    """Normalised supplier, plant and mix categories and their combinations."""
    base = {
        "SupplierCategory": E.category(supplier),
        "PlantCategory": E.category(plant),
        "MixCategory": E.category(mix),
    }
    if subtype is not None:
        base["TestSubtypeCategory"] = E.category(subtype)
    df = df.withColumns(base)
    parts = [F.col("SupplierCategory"), F.col("PlantCategory"), F.col("MixCategory")]
    return df.withColumns(
        {
            "SupplierPlantCategory": E.joined_key(parts[:2]),
            "SupplierPlantMixCategory": E.joined_key(parts),
        }
    )


def smoothed_means(df: DataFrame, category: str, target: str, smoothing: float = SMOOTHING) -> DataFrame:
    """Category means pulled towards the mean of all rows."""
    prior = df.agg(F.avg(target)).scalar()
    stats = df.groupBy(category).agg(F.sum(target).alias("_sum"), F.count(target).alias("RowCount"))
    return stats.withColumn(
        "SmoothedMean",
        (F.col("_sum") + F.lit(smoothing) * prior) / (F.col("RowCount") + F.lit(smoothing)),
    ).drop("_sum")


def cross_fitted_encode(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    inner_fold: str,
    role: str = "Role",
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """Target mean, log count and unknown flag per context column.

    A train row is encoded from the other inner folds, all other rows from all train rows.
    The prior is the mean of all train rows, also inside the inner folds. This is the cube of
    nested folds with the rows that are not for training as its one outer fold.
    """
    train = F.col(role) == "train"
    place = F.when(train, F.coalesce(F.col(inner_fold) + 1, F.lit(-1)))
    work = df.withColumns({"_fold": F.when(train, F.lit(2)).otherwise(F.lit(1)), "_inner": F.array(place)})
    cube = context_cube(work, columns, target, "_fold", "_inner")
    prior = df.where(train).agg(F.avg(target)).scalar()
    new = fold_encodings(columns, 1, F.col("_prior"), "_fold", "_inner", smoothing)
    return with_encodings(work, columns, cube, new, "_fold", "_inner", prior).drop("_fold", "_inner")


# --------------------------------------------------------------------------
# All outer folds at once
# --------------------------------------------------------------------------
def context_cube(
    df: DataFrame, columns: Sequence[str], target: str, fold: str = "Fold", inner: str = "InnerFolds"
) -> DataFrame:
    """Target sums per (context column, category, outer fold, inner fold).

    For outer fold ``o`` the rows outside it stand under their inner fold of that training
    side, and the rows inside it under inner fold 0; outer fold 0 holds all rows. Rows are
    first added up per category and pair of folds, so only those sums are multiplied.
    """
    long = unpivot(df, [fold, inner, target], columns, "ContextColumn", "Category", "string")
    sums = long.groupBy("ContextColumn", "Category", fold, inner).agg(
        F.sum(target).cast("double").alias("s"), F.count(target).alias("n")
    )
    # Few sums are left per category; dealt by category, what follows needs no further exchange.
    sums = sums.repartition("ContextColumn", "Category")
    outer = F.transform(F.col(inner), lambda i, at: F.struct((at + 1).alias("o"), F.coalesce(i, F.lit(0)).alias("i")))
    cells = F.concat(outer, F.array(F.struct(F.lit(0).alias("o"), F.lit(0).alias("i"))))
    return (
        sums.select("ContextColumn", "Category", F.explode(cells).alias("cell"), "s", "n")
        .groupBy("ContextColumn", "Category", F.col("cell.o").alias("OuterFold"), F.col("cell.i").alias("InnerFold"))
        .agg(F.sum("s").alias("Sum"), F.sum("n").alias("Count"))
    )


_INNER_BASE = 1000  # cell (o, i) has the key o * 1000 + i


def with_context_cells(df: DataFrame, columns: Sequence[str], cube: DataFrame) -> DataFrame:
    """Adds ``_cells``: the cube's entries of the row's own categories, by context column.

    The entries are attached to the distinct combinations of categories first, so the rows
    take part in one join for all columns and all folds; one or two columns are joined directly.
    """
    key = (F.col("OuterFold") * F.lit(_INNER_BASE) + F.col("InnerFold")).alias("key")
    lookup = cube.groupBy("ContextColumn", "Category").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.struct(F.col("Sum").alias("s"), F.col("Count").alias("n"))))).alias("cells")
    )
    if len(columns) <= 2:
        for c in columns:
            side = lookup.where(F.col("ContextColumn") == c).select(F.col("Category").alias(c), F.col("cells").alias(f"_cells_{c}"))
            df = df.join(side, c, "left")
        pairs = [x for c in columns for x in (F.lit(c), F.col(f"_cells_{c}"))]
        return df.withColumn("_cells", F.create_map(*pairs)).drop(*[f"_cells_{c}" for c in columns])
    tuples = df.select(*columns).distinct()
    named = tuples.withColumn("_pairs", F.array(*[F.struct(F.lit(c).alias("ContextColumn"), F.col(c).alias("Category")) for c in columns]))
    long = named.select(*columns, F.explode("_pairs").alias("p")).select(*columns, "p.*")
    cells = long.join(lookup, ["ContextColumn", "Category"]).groupBy(*columns).agg(
        F.map_from_entries(F.collect_list(F.struct("ContextColumn", "cells"))).alias("_cells")
    )
    return df.join(cells, list(columns), "left")


def with_encodings(
    df: DataFrame, columns: Sequence[str], cube: DataFrame, new: Mapping[str, Column], fold: str, inner: str, prior: Column | None = None
) -> DataFrame:
    """Adds columns made from ``_cells``, the fold and the inner folds, and ``_prior`` where given.

    Rows alike in categories and folds have the same encodings, so these are worked out once
    per combination and joined to the rows. The combinations are stored first: where they are
    few, the join then leaves the rows in place.
    """
    keys = [*columns, fold, inner]
    made = with_context_cells(df.select(*keys).distinct(), columns, cube)
    made = (made if prior is None else made.withColumn("_prior", prior)).withColumns(dict(new)).select(*keys, *new)
    return join_on(df.drop(*new), stored(made), keys, "left", null_safe=True)


def fold_priors(cube: DataFrame, column: str) -> dict[int, float]:
    """Mean target of the training side of each outer fold; at most one row per fold reaches the driver."""
    sums = cube.where((F.col("ContextColumn") == column) & (F.col("InnerFold") == 0)).groupBy("OuterFold").agg(F.sum("Sum"), F.sum("Count"))
    by_fold = {o: (s, n) for o, s, n in sums.collect()}
    s, n = by_fold[0]
    return {o: (s - a) / (n - b) for o, (a, b) in by_fold.items() if o and n > b}  # a fold that holds all rows has none


def fold_encodings(
    columns: Sequence[str],
    outer: int | Column,
    prior: float | Column,
    fold: str = "Fold",
    inner: str = "InnerFolds",
    smoothing: float = SMOOTHING,
) -> dict[str, Column]:
    """Target mean, log count and unknown flag of every context column for one outer fold.

    Sums of the training side are all rows minus the outer fold; a training row also leaves
    its own inner fold out. Needs ``_cells``.
    """
    o = outer if isinstance(outer, Column) else F.lit(outer)
    pull = F.lit(float(smoothing)) * (prior if isinstance(prior, Column) else F.lit(float(prior)))
    own = o * F.lit(_INNER_BASE)
    inside = F.col(fold) == o
    mine = own + F.element_at(F.col(inner), o)
    new: dict[str, Column] = {}
    for c in columns:
        cells = F.try_element_at("_cells", F.lit(c))

        def part(key: Column, field: str, cells: Column = cells) -> Column:
            return F.coalesce(F.try_element_at(cells, key)[field], F.lit(0))

        rows = part(F.lit(0), "n") - part(own, "n")
        total = part(F.lit(0), "s") - part(own, "s")
        rest_n = F.when(inside, rows).otherwise(rows - part(mine, "n"))
        rest_s = F.when(inside, total).otherwise(total - part(mine, "s"))
        new[f"{c}_TargetMean"] = (rest_s + pull) / (rest_n + F.lit(float(smoothing)))
        new[f"{c}_LogCount"] = F.log1p(rows.cast("double"))
        new[f"{c}_Unknown"] = E.flag(rows == 0)
    return new


def grid_encodings(columns: Sequence[str], priors: Mapping[int, float], fold: str = "Fold", inner: str = "InnerFolds") -> Column:
    """The encodings of all outer folds: per fold the three numbers of every context column.

    One lambda over the folds, so the expression does not grow with their number.
    """
    folds = max(priors)
    means = F.array(*[F.lit(float(priors.get(o, 0.0))) for o in range(1, folds + 1)])

    def of_fold(o: Column) -> Column:
        new = fold_encodings(columns, o, F.element_at(means, o), fold, inner)
        return F.array(*[v.cast("double") for v in new.values()])

    return F.transform(F.sequence(F.lit(1), F.lit(folds)), of_fold)


def encoding_metadata(df: DataFrame, columns: Sequence[str], fold: str = "Fold") -> DataFrame:
    """Category counts and unknown validation rows per context column and fold.

    A category is unknown to a fold's training rows when all its rows are in the fold.
    """
    rows = unpivot(df, [fold], columns, "ContextColumn", "Category", "string")
    counts = rows.groupBy("ContextColumn", "Category", fold).agg(F.count(F.lit(1)).alias("n"))
    only_here = F.col("n") == F.sum("n").over(Window.partitionBy("ContextColumn", "Category"))
    per_fold = (
        counts.withColumn("_only", only_here)
        .groupBy("ContextColumn", fold)
        .agg(
            F.count(F.lit(1)).alias("ValidationUniqueCategories"),
            E.count_if(F.col("_only")).alias("_own"),
            F.sum("n").alias("ValidationRows"),
            F.sum(F.when(F.col("_only"), F.col("n")).otherwise(F.lit(0))).alias("UnknownValidationRows"),
        )
    )
    distinct = counts.select("ContextColumn", "Category").distinct().groupBy("ContextColumn").agg(
        F.count(F.lit(1)).alias("_all")
    )
    return (
        per_fold.join(distinct, "ContextColumn")
        .withColumns(
            {
                "TrainUniqueCategories": F.col("_all") - F.col("_own"),
                "UnknownValidationPercent": F.col("UnknownValidationRows") / F.col("ValidationRows") * 100.0,
            }
        )
        .drop("_all", "_own", "ValidationRows")
    )


def context_coverage(metadata: DataFrame) -> DataFrame:
    """Mean and maximum unknown share and mean category count over the folds."""
    return metadata.groupBy("ContextColumn").agg(
        F.avg("UnknownValidationPercent").alias("MeanUnknownValidationPercent"),
        F.max("UnknownValidationPercent").alias("MaxUnknownValidationPercent"),
        F.avg("TrainUniqueCategories").alias("MeanTrainUniqueCategories"),
    )


# --------------------------------------------------------------------------
# Exact preprocessing fitted on the train rows only
# --------------------------------------------------------------------------
def train_medians(df: DataFrame, columns: Sequence[str], role: str = "Role") -> DataFrame:
    """One row with the exact train median of each column."""
    long = unpivot(df.where(F.col(role) == "train"), [], columns)
    medians = selected_quantiles(long, ["Column"], "Value", {"m": 0.5})
    return medians.agg(*[F.max(F.when(F.col("Column") == c, F.col("m"))).alias(c) for c in columns])


def impute_medians(df: DataFrame, columns: Sequence[str], role: str = "Role") -> DataFrame:
    """Missing values become the train median; one indicator column per feature."""
    fitted = train_medians(df, columns, role)
    df = df.withColumn("_median", fitted.select(F.struct(*columns)).scalar())
    cols: dict[str, Column] = {f"{c}_WasMissing": E.flag(F.col(c).isNull()) for c in columns}
    cols |= {c: F.coalesce(F.col(c).cast("double"), F.col(f"_median.{c}")) for c in columns}
    return df.withColumns(cols).drop("_median")


def standardize(df: DataFrame, columns: Sequence[str], role: str = "Role") -> DataFrame:
    """Zero mean and unit population deviation on the train rows."""
    fitted = df.where(F.col(role) == "train").agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]
        ).alias("s")
    )
    df = df.withColumn("_fit", fitted.scalar())
    scaled = {
        f"{c}_Scaled": (F.col(c) - F.col(f"_fit.{c}_m")) / F.coalesce(F.nullif(F.col(f"_fit.{c}_s"), F.lit(0.0)), F.lit(1.0))
        for c in columns
    }
    return df.withColumns(scaled).drop("_fit")


def baseline_predictions(df: DataFrame, target: str, failure: str, role: str = "Role") -> DataFrame:
    """Train mean, train median and train failure share for every test row."""
    train = df.where(F.col(role) == "train")
    mean = train.agg(F.struct(F.avg(target).alias("mean"), F.avg(failure).alias("prior")).alias("s"))
    median = selected_quantiles(train, [], target, {"m": 0.5})
    test = df.where(F.col(role) == "test").withColumns({"_s": mean.scalar(), "DummyMedian": median.scalar()})
    return test.withColumns({"DummyMean": F.col("_s.mean"), "DummyPrior": F.col("_s.prior")}).drop("_s")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight of each class: rows / (2 * rows of the class)."""
    one = df.where(F.col(label).isNotNull()).agg(
        F.struct(E.count_if(F.col(label) == 0).alias("zero"), E.count_if(F.col(label) == 1).alias("one")).alias("c")
    )
    df = df.withColumn("_c", one.scalar())
    total = F.col("_c.zero") + F.col("_c.one")
    own = F.when(F.col(label) == 1, F.col("_c.one")).when(F.col(label) == 0, F.col("_c.zero"))
    return df.withColumn("ClassWeight", E.safe_div(total, own * 2)).drop("_c")
