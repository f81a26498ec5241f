"""Ranks, running totals and exact quantiles that never gather a group in one task.

A group may hold a third of all rows, so nothing here sorts a whole group in one
partition. Values are first counted per distinct value (combined map-side), then
split into order-preserving buckets. Offsets come from the short table of bucket
totals, and only rows of one bucket are ordered together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 1024
_EXPONENT_SHIFT = 1100  # keeps log2 of every positive double above zero
_LAST_BUCKET = 1 << 40


def value_bucket(value: Column | str) -> Column:
    """Bucket number that grows with the value: 1024 steps per power of two.

    Infinities take the outermost buckets; NULL and NaN have none.
    """
    v = F.col(value) if isinstance(value, str) else value
    endless = F.abs(v) == F.lit(float("inf"))
    step = (
        F.floor((F.log2(F.when(~endless, F.abs(v))) + F.lit(float(_EXPONENT_SHIFT))) * F.lit(float(BUCKETS_PER_DOUBLING)))
        + 1
    ).cast("long")
    step = F.when(endless, F.lit(_LAST_BUCKET)).otherwise(step)
    return F.when(F.isnan(v), None).when(v > 0, step).when(v < 0, -step).when(v == 0, F.lit(0).cast("long"))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join that keeps the left key columns; ``null_safe`` also matches NULL keys."""
    if not null_safe:
        return left.join(right, list(keys), how)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Mapping[str, Column],
    descending: bool = False,
) -> DataFrame:
    """One row per distinct (keys, value) with running totals in value order.

    For each measure ``m`` the result has ``m`` (at the value), ``m_upto``
    (including the value) and ``m_total`` (of the key). NULL and NaN are left out;
    key columns must not be NULL.
    """
    keys = list(keys)
    per_value = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, value)
        .agg(*[F.sum(c).alias(m) for m, c in measures.items()])
        .withColumn("_bucket", value_bucket(F.col(value).cast("double")))
    )
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    value_order = F.col(value).desc() if descending else F.col(value).asc()
    key_part = keys or [F.lit(0)]
    along = Window.partitionBy(*key_part).orderBy(bucket_order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*key_part)
    offsets = (
        per_value.groupBy(*keys, "_bucket")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *keys,
            "_bucket",
            *[(F.sum(m).over(along) - F.col(m)).alias(f"_before_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value_order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = per_value.select(
        *keys,
        value,
        "_bucket",
        *measures,
        *[F.sum(m).over(inside).alias(f"_inside_{m}") for m in measures],
    )
    return ranked.join(offsets, [*keys, "_bucket"]).select(
        *keys,
        value,
        *measures,
        *[(F.col(f"_before_{m}") + F.col(f"_inside_{m}")).alias(f"{m}_upto") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    along: Mapping[str, tuple[Column, float]] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    ``along`` maps further names to (expression, probability). The expressions are of the value and
    the keys and never fall as the value grows, so the ranks of the value are theirs too.
    """
    ranks = running_sums(df, keys, value, {"_n": F.lit(1)})
    before, upto, total = F.col("_n_upto") - F.col("_n"), F.col("_n_upto"), F.col("_n_total")
    v = F.col(value).cast("double")

    def at(rank: Column, expression: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < upto), expression))

    aggs, outs = [], []
    for name, (expression, p) in ({n: (v, p) for n, p in probs.items()} | dict(along or {})).items():
        position = F.lit(float(p)) * (total - 1)
        aggs += [
            at(F.floor(position), expression).alias(f"_{name}_lo"),
            at(F.ceil(position), expression).alias(f"_{name}_hi"),
            F.max(position - F.floor(position)).alias(f"_{name}_part"),
        ]
        low = F.col(f"_{name}_lo")
        high = F.col(f"_{name}_hi")
        # Equal neighbours need no step between them, and infinite ones have none.
        outs.append(F.when(low == high, low).otherwise(low + (high - low) * F.col(f"_{name}_part")).alias(name))
    return ranks.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def selected_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of a few large groups, one row per key.

    Rows are counted per order-preserving bucket; the counts show which buckets hold the wanted
    ranks, and only values of those buckets are read again, counted and ordered. For many small
    groups ``exact_quantiles`` moves less. Keys must not be NULL.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v")).withColumn("_bucket", value_bucket("_v"))
    counts = known.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    along = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"_before": F.sum("_n").over(along) - F.col("_n"), "_total": F.sum("_n").over(whole)})
    here = F.filter(_wanted_ranks(probs), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    wanted = placed.select(*keys, "_bucket", "_before", "_total", here.alias("_ranks")).where(F.size("_ranks") > 0)
    # The buckets of the ranks go to the rows, not the rows to the buckets: few keys have few of them.
    values = known.join(wanted, [*keys, "_bucket"]).groupBy(*keys, "_bucket", "_v", "_before", "_total", "_ranks").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    hit = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))
    return _between_ranks(own.select(*keys, "_total", "_v", F.explode(hit).alias("_rank")), keys, probs)


def _wanted_ranks(probs: Mapping[str, float]) -> Column:
    """The two neighbouring ranks of every quantile among ``_total`` values."""
    last = F.col("_total") - 1
    pairs = [F.array(F.floor(F.lit(float(p)) * last), F.ceil(F.lit(float(p)) * last)) for p in probs.values()]
    return F.array_distinct(F.flatten(F.array(*pairs)))


def _between_ranks(found: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from the values ``_v`` at the wanted ranks."""
    aggs, outs = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        aggs += [
            F.max(F.when(F.col("_rank") == F.floor(at), F.col("_v"))).alias(f"_{name}_lo"),
            F.max(F.when(F.col("_rank") == F.ceil(at), F.col("_v"))).alias(f"_{name}_hi"),
            F.max(at - F.floor(at)).alias(f"_{name}_part"),
        ]
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append(F.when(low == high, low).otherwise(low + (high - low) * F.col(f"_{name}_part")).alias(name))
    return found.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def leave_out_quantiles(
    df: DataFrame, keys: Sequence[str], part: str, value: str, probs: Mapping[str, float], times: str | None = None
) -> DataFrame:
    """Exact quantiles of everything but one part: one row per (keys, part left out).

    ``times`` names a column that says how often a row counts.

    Values are counted per order-preserving bucket and part; the counts without a part are
    the bucket's counts minus the part's own. They show which buckets hold the wanted ranks,
    and only rows of those buckets are ordered. ``df`` is read twice and no value outside
    those buckets is shuffled. Key and part must not be NULL; NULL and NaN values are left out.
    A part without which nothing is left has no row.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    often = F.col(times) if times else F.lit(1)
    known = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, part, v.alias("_v"), often.cast("long").alias("_times"))
    known = known.withColumn("_bucket", value_bucket("_v"))
    counts = known.groupBy(*keys, "_bucket", part).agg(F.sum("_times").alias("_n"))
    buckets = counts.groupBy(*keys, "_bucket").agg(
        F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct(part, "_n"))).alias("_by_part")
    )
    parts = df.agg(F.collect_set(part)).scalar()
    left_out = buckets.withColumn("_left", F.explode(parts))
    left_out = left_out.withColumn("_rest", F.col("_all") - F.coalesce(F.try_element_at("_by_part", F.col("_left")), F.lit(0)))
    whole = Window.partitionBy(*keys, "_left")
    along = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = left_out.withColumns(
        {"_before": F.sum("_rest").over(along) - F.col("_rest"), "_total": F.sum("_rest").over(whole)}
    )
    here = F.filter(_wanted_ranks(probs), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rest")))
    wanted = placed.where("_total > 0").select(*keys, "_bucket", "_left", "_before", "_total", here.alias("_ranks")).where(F.size("_ranks") > 0)

    needed = wanted.select(*keys, "_bucket").distinct()
    values = known.join(needed, [*keys, "_bucket"]).groupBy(*keys, "_bucket", "_v", part).agg(F.sum("_times").alias("_n"))
    values = values.groupBy(*keys, "_bucket", "_v").agg(
        F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct(part, "_n"))).alias("_by_part")
    )
    inside = Window.partitionBy(*keys, "_bucket", "_left").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = values.join(wanted, [*keys, "_bucket"]).withColumn(
        "_rest", F.col("_all") - F.coalesce(F.try_element_at("_by_part", F.col("_left")), F.lit(0))
    )
    own = own.withColumn("_upto", F.col("_before") + F.sum("_rest").over(inside))
    hit = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_rest")) & (r < F.col("_upto")))
    found = own.select(*keys, F.col("_left").alias(part), "_total", "_v", F.explode(hit).alias("_rank"))
    return _between_ranks(found, [*keys, part], probs)


def with_quantiles(
    df: DataFrame, grouped: DataFrame, keys: Sequence[str], quantiles: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Add quantiles of several columns to an aggregate over the same keys.

    ``quantiles`` maps a value column to ``{output name: probability}``. All columns
    are ranked together in one long table.
    """
    keys = list(keys)
    names = {n: (c, p) for c, probs in quantiles.items() for n, p in probs.items()}
    long = unpivot(df, keys, list(quantiles), "_column", "_value")
    probs = sorted({p for _, p in names.values()})
    labels = {p: f"q{i}" for i, p in enumerate(probs)}
    per_column = exact_quantiles(long, [*keys, "_column"], "_value", {labels[p]: p for p in probs})
    wide = per_column.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_column") == c, F.col(labels[p]))).alias(n) for n, (c, p) in names.items()]
    )
    return grouped.join(wide, keys, "left")


def unpivot(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "Column", value: str = "Value", as_type: str = "double"
) -> DataFrame:
    """Columns to rows: one row per input row and column."""
    typed = df.select(*keys, *[F.col(c).cast(as_type).alias(c) for c in columns])
    return typed.unpivot(list(keys), list(columns), name, value)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per distinct value: its average rank and the group size."""
    sums = running_sums(df, keys, value, {"_n": F.lit(1)})
    rank = F.col("_n_upto") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)
    return sums.select(*keys, value, rank.alias("AverageRank"), F.col("_n_total").alias("GroupSize"))


def with_percentile_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank as percent of the group size; 100 for a group of one row."""
    ranks = average_ranks(df, keys, value)
    joined = df.join(ranks, [*keys, value], "left")
    share = F.when(F.col("GroupSize") <= 1, F.lit(100.0)).otherwise(
        F.col("AverageRank") / F.col("GroupSize") * F.lit(100.0)
    )
    return joined.withColumn(name, share).drop("AverageRank", "GroupSize")


def spread_row_number(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[tuple[str, bool]],
    order: Sequence[Column],
    name: str,
) -> DataFrame:
    """Row number inside ``keys`` ordered by ``coarse`` and then ``order``.

    ``coarse`` lists leading sort columns as (column, ascending). Only rows equal in
    them are sorted together; the numbers before them come from a table of counts.
    """
    coarse_names = [c for c, _ in coarse]
    coarse_order = [F.col(c).asc() if up else F.col(c).desc() for c, up in coarse]
    along = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(*coarse_order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    group = [*keys, *coarse_names]
    offsets = (
        df.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*group, (F.sum("_rows").over(along) - F.col("_rows")).alias("_before"))
    )
    inside = Window.partitionBy(*group).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    return (
        join_on(numbered, offsets, group, null_safe=True)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_before", "_inside")
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key by a total order.

    Spark limits each group inside every input task before the exchange, so a hot
    group sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(*order)
    name = rank or "_row"
    kept = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    tie: str,
    value: str,
    rows: int,
    name: str,
    block: int = 100_000,
) -> DataFrame:
    """Mean over the last ``rows`` rows of a group in date order, fewer at its start.

    A group is cut into blocks of ``block`` rows; the last rows of a block are
    repeated in front of the next one, so a long history is spread over tasks.
    """
    numbered = spread_row_number(df, keys, [(day, True)], [F.col(tie)], "_position")
    home = F.floor((F.col("_position") - 1) / F.lit(block)).cast("long")
    left_over = F.lit(block) - ((F.col("_position") - 1) % F.lit(block))
    spread = numbered.withColumn("_home", home).withColumn(
        "_block",
        F.explode(
            F.when(left_over < rows, F.array(home, home + 1)).otherwise(F.array(home))
        ),
    )
    last = Window.partitionBy(*keys, "_block").orderBy("_position").rowsBetween(-(rows - 1), 0)
    return (
        spread.withColumn(name, F.avg(value).over(last))
        .where(F.col("_block") == F.col("_home"))
        .drop("_home", "_block", "_position")
    )
