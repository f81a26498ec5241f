"""Linear models of all feature sets and outer folds, fitted together.

A model frame is packed once: plain features, encoded context per outer fold, label, fold and
id. Cross-products are added up in one pass (least squares, ridge), or in one pass a Newton
step (balanced logistic regression); every (feature set, fold, penalty) is then solved from
those sums on the driver, which sees matrices of the width of the features and no rows.

Missing values need no pass of their own: with z the value (0 where missing) and m its
indicator, the imputed value is z + median * m, so cross-products of imputed columns follow
from those of z and m. Sums of a training side are all rows minus the fold. Columns are
shifted by their mean before they are multiplied, which keeps the differences exact enough
for strengths of thousands of psi.

As in the usual set-up, values are imputed by the training median, indicators are added where
the training side misses values, columns are scaled to unit population deviation and columns
that are constant on the training side carry nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import encode as N
from pourstat.operators import metrics as M
from pourstat.operators.order_stats import leave_out_quantiles
from pourstat.operators.splits import group_folds
from pourstat.session import durable, ship_package, stored

PARTS = ("TargetMean", "LogCount", "Unknown")
#: Partial sums that go to the driver at most; beyond it tasks add them up first.
DIRECT_PARTIALS = 64
RIDGE_PENALTY = 10.0


@dataclass(frozen=True)
class Frame:
    """A packed model frame: blocks of tests, checkpointed because every pass reads them.

    A row of ``rows`` is one block. Lists hold its _id, _fold, _y, _label (0/1), ``_required``
    and extra columns; _x (plain features, NaN where missing) and _context (per outer fold the
    encoded columns of every label, empty without context) are the bytes of matrices, which tasks
    read in place.
    """

    rows: DataFrame
    plain: tuple[str, ...]
    context: tuple[str, ...]
    folds: int
    medians: np.ndarray  # outer fold x plain feature; NaN where the training side is empty
    median_target: np.ndarray
    shift: np.ndarray  # of the plain features
    shift_y: float
    shift_context: np.ndarray
    tasks: int = 1  # partitions of the rows
    extra: tuple[str, ...] = ()  # columns that predictions carry along
    labels: tuple[str, ...] = ()  # context is encoded with the means of each
    label: int = 0  # the one whose encodings are read
    shifts_context: tuple[np.ndarray, ...] = ()  # by label

    def encoded_by(self, label: str) -> Frame:
        """The same frame with the encodings of another of its labels."""
        k = self.labels.index(label)
        return replace(self, label=k, shift_context=self.shifts_context[k])

    @property
    def width(self) -> int:
        return 2 * len(self.plain) + len(self.context)


@dataclass(frozen=True)
class Linear:
    """A fitted row function ``constant + weights . [z, m, context]`` of one outer fold."""

    feature_set: str
    model: str
    fold: int
    constant: float
    weights: np.ndarray


def pack(
    rows: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    folds: int = 5,
    label: str | Sequence[str] = S.TARGET,
    fold: str = "Fold",
    inner: str = "InnerFolds",
    ident: str = "testId",
    extra: Sequence[str] = (),
) -> Frame:
    """The model frame of rows that carry ``Fold`` and ``InnerFolds`` and, where a feature set
    asks for it, context categories. Context is encoded with the mean of ``label``; of several
    labels the frame has the encodings of each and starts with the first.
    """
    labels = (label,) if isinstance(label, str) else tuple(label)
    ship_package(rows.sparkSession)
    context = tuple(f"{c}_{p}" for c in N.CONTEXT for p in PARTS)
    named = list(dict.fromkeys(c for f in feature_sets.values() for c in f))
    used = context if any(c in context for c in named) else ()
    plain = tuple(c for c in named if c not in context)
    leaks = sorted(set(plain) & set(S.LEAKAGE_COLUMNS))
    if leaks:
        raise ValueError(f"feature sets contain leakage columns: {leaks}")
    narrow = rows.select(
        F.col(ident).alias("_id"),
        F.col(fold).alias("Fold"),
        F.col(inner).alias("InnerFolds"),
        *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(plain)],
        F.col(S.TARGET).cast("double").alias("_y"),
        F.col(S.FAILURE).cast("int").alias("_label"),
        F.col(S.REQUIRED).cast("double").alias("_required"),
        *[F.col(c).cast("double").alias(f"_encoded{k}") for k, c in enumerate(labels)],
        *([F.col(c) for c in N.CONTEXT] if used else []),
        *[F.col(c).alias(f"_extra_{c}") for c in extra],
    )
    narrow = stored(narrow)
    shifts = tuple(np.zeros(len(used)) for _ in labels)
    context_column = F.lit(None).cast("array<array<double>>")
    if used:
        made = []
        for k, shift in enumerate(shifts):
            cube = durable(N.context_cube(narrow, N.CONTEXT, f"_encoded{k}"))
            priors = N.fold_priors(cube, N.CONTEXT[0])
            shift[:: len(PARTS)] = np.mean(list(priors.values()))
            made.append((cube, {f"_context{k}": N.grid_encodings(N.CONTEXT, priors)}))
        for cube, new in made:
            narrow = N.with_encodings(narrow, N.CONTEXT, cube, new, "Fold", "InnerFolds")
        context_column = F.col("_context0")
        for k in range(1, len(labels)):
            context_column = F.zip_with(context_column, F.col(f"_context{k}"), lambda a, b: F.concat(a, b))
    heads = ["_id", F.col("Fold").alias("_fold"), "_y", "_label", "_required", *[f"_extra_{c}" for c in extra]]
    packed = durable(_blocks(narrow.select(*heads, *[f"_x{k}" for k in range(len(plain))], context_column.alias("_context")), len(plain)))
    nothing = np.full((folds, len(plain)), np.nan)
    tasks = packed.rdd.getNumPartitions()
    f = Frame(
        packed, plain, used, folds, nothing, nothing[:, 0], np.zeros(len(plain)), 0.0, shifts[0], tasks, tuple(extra), labels, 0, shifts
    )
    sums = add_up(f, lambda b: {"s": np.nansum(b.values, axis=0), "n": (~np.isnan(b.values)).sum(axis=0).astype(float)})
    means = sums["s"] / np.maximum(sums["n"], 1.0) if sums else np.zeros(1 + len(plain))
    medians = leave_out_quantiles(stored(_value_counts(f)), ["Column"], "_fold", "Value", {"m": 0.5}, "_rows")
    table = np.full((folds, 1 + len(plain)), np.nan)
    for r in medians.where(F.col("_fold") <= folds).collect():  # folds x features numbers
        table[r["_fold"] - 1, r["Column"]] = r["m"]
    return replace(f, medians=table[:, 1:], median_target=table[:, 0], shift=means[1:], shift_y=float(means[0]))


def pack_holdout(
    rows: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    label: str | Sequence[str] = S.TARGET,
    group: str = "SplitGroup",
    inner: int = 5,
    extra: Sequence[str] = (),
) -> Frame:
    """The model frame of rows that carry ``Role``: one outer fold that holds the test rows.

    Context of the training rows is encoded over folds of their own groups.
    """
    within = stored(group_folds(rows.where(F.col("Role") == "train"), group, inner, "_within"))
    train = F.col("Role") == "train"
    placed = rows.join(within, group, "left").withColumns(
        {"_outer": F.when(train, F.lit(2)).otherwise(F.lit(1)), "_inners": F.array(F.when(train, F.col("_within")))}
    )
    return pack(placed, feature_sets, 1, label, "_outer", "_inners", extra=extra)


# --------------------------------------------------------------------------
# Passes
# --------------------------------------------------------------------------
class Block(NamedTuple):
    """Arrays of one block: fold, target and label of its rows, plain features (NaN where missing) and context (rows x folds x columns)."""

    fold: np.ndarray
    y: np.ndarray
    label: np.ndarray
    x: np.ndarray
    context: np.ndarray

    @property
    def values(self) -> np.ndarray:
        """Target and plain features side by side."""
        return np.column_stack([self.y, self.x])


#: What a pass over the blocks reads; predictions read the other columns too.
_READ = ("_fold", "_y", "_label", "_x", "_context")
#: Rows of a block, and distinct values a task counts before it hands them on.
BLOCK_ROWS = 2048
HELD_VALUES = 1 << 16


def _blocks(rows: DataFrame, plain: int) -> DataFrame:
    """Blocks of the rows, see ``Frame``; plain features are the columns ``_x0``, ``_x1`` and so on."""
    values = [f"_x{k}" for k in range(plain)]
    lists = [c for c in rows.columns if c not in (*values, "_context")]
    types = {r.name: r.dataType.simpleString() for r in rows.schema}

    def numbers(column: pa.Array) -> np.ndarray:
        while pa.types.is_list(column.type):
            column = column.flatten()
        return column.to_numpy(zero_copy_only=False).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                held = [pa.ListArray.from_arrays([0, part.num_rows], pa.concat_arrays([part.column(c)])) for c in lists]
                x = np.column_stack([numbers(part.column(c)) for c in values]) if values else np.zeros((part.num_rows, 0))
                bytes_ = [pa.array([v.tobytes()], pa.binary()) for v in (x, numbers(part.column("_context")))]
                yield pa.RecordBatch.from_arrays([*held, *bytes_], [*lists, "_x", "_context"])

    ddl = ", ".join(f"`{c}` array<{types[c]}>" for c in lists)
    return rows.mapInArrow(run, f"{ddl}, _x binary, _context binary")


def _read(batch: pa.RecordBatch, f: Frame) -> Iterator[Block]:
    """The blocks of a batch, with the encodings of the frame's label."""
    q = len(f.context)
    for k in range(batch.num_rows):
        fold, y, label = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("_fold", "_y", "_label"))
        x, context = (np.frombuffer(batch.column(c)[k].as_buffer() or b"", float) for c in ("_x", "_context"))
        context = context.reshape(len(fold), f.folds if q else 0, q * len(f.labels))[:, :, f.label * q : (f.label + 1) * q]
        yield Block(fold, y, label, x.reshape(len(fold), len(f.plain)), context)


def _batch_arrays(b: Block, f: Frame) -> tuple[np.ndarray, ...]:
    """Fold, z, m and context (rows x folds x columns) of a block, shifted."""
    missing = np.isnan(b.x)
    z = np.where(missing, 0.0, b.x - f.shift)
    context = b.context - f.shift_context if f.context else np.zeros((len(b.fold), f.folds, 0))
    return b.fold, z, missing.astype(float), context


def _value_counts(f: Frame) -> DataFrame:
    """How often target (column 0) and plain features have each value per fold: (Column, _fold, Value, _rows).

    A task counts what it has read and hands on counts when it holds too many values, so a
    value may have several rows.
    """
    light = _light(f)

    def rows(held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        at, part = (np.repeat(np.array([key[k] for key in held], np.int32), [len(v) for v, _ in held.values()]) for k in (0, 1))
        values, n = (np.concatenate([x[k] for x in held.values()]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(part), pa.array(values), pa.array(n)], ["Column", "_fold", "Value", "_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: dict[tuple[int, int], list[np.ndarray]] = {}
        size: dict[tuple[int, int], int] = {}
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def settle(key: tuple[int, int]) -> None:
            values, n = np.unique(np.concatenate(fresh.pop(key)), return_counts=True)
            if key in held:
                values, at = np.unique(np.concatenate([held[key][0], values]), return_inverse=True)
                n = np.bincount(at, np.concatenate([held[key][1], n]), len(values)).astype(np.int64)
            size[key], held[key] = 0, (values, n)

        for batch in batches:
            for b in _read(batch, light):
                matrix = b.values
                for o in np.unique(b.fold).tolist():
                    for k, v in enumerate(matrix[b.fold == o].T):
                        v = v[~np.isnan(v)]
                        if not len(v):
                            continue
                        fresh.setdefault((k, o), []).append(v)
                        size[k, o] = size.get((k, o), 0) + len(v)
                        if size[k, o] >= HELD_VALUES:
                            settle((k, o))
                            if len(held[k, o][0]) > HELD_VALUES // 2:
                                yield rows({(k, o): held.pop((k, o))})
        for key in list(fresh):
            settle(key)
        if held:
            yield rows(held)

    return f.rows.select(*_READ).mapInArrow(run, "Column int, _fold int, Value double, _rows long")


def _light(f: Frame) -> Frame:
    """The frame's numbers without its DataFrame, as tasks need them."""
    return replace(f, rows=None)


Sums = dict[str, np.ndarray]


def add_up(f: Frame, contribute: Callable[[Block], Sums]) -> Sums:
    """Named arrays summed over all blocks.

    Each task adds up its blocks and hands on one row per name. Where there are many tasks,
    their partial sums are added up by about the square root of their number first, so the
    driver receives few of them.
    """

    light = _light(f)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for batch in batches:
            for b in _read(batch, light):
                for name, value in contribute(b).items():
                    total[name] = total[name] + value if name in total else value
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))], ["name", "value"]
            )

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for batch in batches:
            values = batch.column("value")
            for k, name in enumerate(batch.column("name").to_pylist()):
                value = values[k].values.to_numpy(zero_copy_only=False)
                total[name] = total[name] + value if name in total else value
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], ["name", "value"])

    ddl = "name string, value array<double>"
    parts = f.rows.select(*_READ).mapInArrow(partial, ddl)
    if f.tasks > DIRECT_PARTIALS:
        parts = parts.repartition(math.isqrt(f.tasks)).mapInArrow(again, ddl)
    out: Sums = {}
    for r in parts.collect():
        value = np.array(r["value"])
        out[r["name"]] = out[r["name"]] + value if r["name"] in out else value
    return out


@dataclass(frozen=True)
class Moments:
    """Cross-products of [1, z, m, context, y, label] over the training side of one outer fold."""

    total: np.ndarray

    @property
    def rows(self) -> float:
        return self.total[0, 0]


def training_moments(f: Frame) -> dict[int, Moments]:
    """Cross-products of every training side from one pass.

    Columns that are the same for all outer folds are multiplied once per row, into the sums
    of the row's own fold, and a training side is all folds minus its own. Encoded context
    differs by outer fold, so its blocks are added up per training side.
    """
    light = _light(f)
    p, q, k = len(f.plain), len(f.context), f.folds

    def contribute(b: Block) -> Sums:
        fold, z, m, context = _batch_arrays(b, light)
        base = np.column_stack([np.ones(len(fold)), z, m, b.y - light.shift_y, b.label.astype(float)])
        beyond = base[fold > k]  # a holdout has all its training rows there
        out: Sums = {"beyond": beyond.T @ beyond}
        for o in range(1, k + 1):
            own = base[fold == o]
            out[f"own{o}"] = own.T @ own
            if q:
                rest = fold != o
                c = context[rest, o - 1]
                out[f"cross{o}"] = base[rest].T @ c
                out[f"context{o}"] = c.T @ c
        return out

    sums = add_up(f, contribute)
    w = 2 * p + 3
    own = {o: sums[f"own{o}"].reshape(w, w) for o in range(1, k + 1)}
    everything = sum(own.values()) + sums["beyond"].reshape(w, w)
    order = [*range(2 * p + 1), *range(w, w + q), 2 * p + 1, 2 * p + 2]
    out = {}
    for o in range(1, k + 1):
        full = np.zeros((w + q, w + q))
        full[:w, :w] = everything - own[o]
        if q:
            full[:w, w:] = sums[f"cross{o}"].reshape(w, q)
            full[w:, :w] = full[:w, w:].T
            full[w:, w:] = sums[f"context{o}"].reshape(q, q)
        out[o] = Moments(full[np.ix_(order, order)])
    return out


# --------------------------------------------------------------------------
# Designs
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class Design:
    """How one feature set of one outer fold is made from [z, m, context]: standardised columns
    ``raw @ transform - centre``, with mean zero and deviation one on the training side."""

    transform: np.ndarray
    centre: np.ndarray
    names: tuple[str, ...]


def design(f: Frame, moments: Moments, fold: int, features: Sequence[str]) -> Design:
    """Imputed, indicated and standardised columns of a feature set."""
    p = len(f.plain)
    n = moments.rows
    columns, names = [], []
    for c in features:
        if c in f.context:
            column = np.zeros(f.width)
            column[2 * p + f.context.index(c)] = 1.0
            columns.append(column)
            names.append(c)
            continue
        k = f.plain.index(c)
        median = f.medians[fold - 1, k]
        if np.isnan(median):
            continue  # no value on the training side
        column = np.zeros(f.width)
        column[k], column[p + k] = 1.0, median - f.shift[k]
        columns.append(column)
        names.append(c)
    for c in features:
        if c in f.plain:
            k = f.plain.index(c)
            if not np.isnan(f.medians[fold - 1, k]) and moments.total[0, 1 + p + k] > 0.5:
                column = np.zeros(f.width)
                column[p + k] = 1.0
                columns.append(column)
                names.append(f"{c}_WasMissing")
    transform = np.column_stack(columns) if columns else np.zeros((f.width, 0))
    first = moments.total[0, 1 : 1 + f.width] / n
    second = moments.total[1 : 1 + f.width, 1 : 1 + f.width] / n
    mean = first @ transform
    square = np.einsum("ij,ik,kj->j", transform, second, transform)
    variance = square - mean**2
    # What differences of sums leave of a constant column is noise.
    varies = variance > 1e-10 * np.maximum(square, 1e-300)
    transform = transform[:, varies] / np.sqrt(variance[varies])
    return Design(transform, first @ transform, tuple(x for x, v in zip(names, varies) if v))


def _centred(f: Frame, moments: Moments, d: Design) -> tuple[np.ndarray, np.ndarray, float]:
    """Standardised columns' Gram matrix, their products with the centred target, and its mean."""
    n, w = moments.rows, f.width
    raw = moments.total[1 : 1 + w, 1 : 1 + w]
    gram = d.transform.T @ raw @ d.transform - n * np.outer(d.centre, d.centre)
    mean_y = moments.total[0, 1 + w] / n
    products = moments.total[1 : 1 + w, 1 + w] @ d.transform - n * d.centre * mean_y
    return gram, products, mean_y


def solve(gram: np.ndarray, products: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights; without a penalty the shortest least-squares solution."""
    if penalty:
        return np.linalg.solve(gram + penalty * np.eye(len(gram)), products)
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-9 * max(values.max(initial=0.0), 1e-300)
    return vectors[:, kept] @ ((vectors[:, kept].T @ products) / values[kept])


def fit_regressions(
    f: Frame, feature_sets: Mapping[str, Sequence[str]], penalties: Mapping[str, float], moments: Mapping[int, Moments] | None = None
) -> list[Linear]:
    """Every (feature set, fold, penalty) solved from one pass, with the constant baselines.

    ``penalties`` maps model names to the penalty on squared weights; 0 is least squares.
    """
    moments = moments or training_moments(f)
    out = []
    for o, own in moments.items():
        mean = own.total[0, 1 + f.width] / own.rows + f.shift_y
        for name, features in feature_sets.items():
            out.append(Linear(name, "DummyMean", o, mean, np.zeros(f.width)))
            out.append(Linear(name, "DummyMedian", o, float(f.median_target[o - 1]), np.zeros(f.width)))
            d = design(f, own, o, features)
            gram, products, mean_y = _centred(f, own, d)
            for model, penalty in penalties.items():
                w = solve(gram, products, penalty)
                out.append(Linear(name, model, o, mean_y + f.shift_y - float(d.centre @ w), d.transform @ w))
    return out


# --------------------------------------------------------------------------
# Balanced logistic regression
# --------------------------------------------------------------------------
@dataclass
class _Cell:
    """One (feature set, fold) during Newton's method."""

    design: Design
    beta: np.ndarray  # weights, then the constant
    flat: float  # loss of the zero weights
    last: np.ndarray | None = None
    loss: float = math.inf
    move: float = math.inf
    done: bool = False


def fit_logistic(
    f: Frame,
    feature_sets: Mapping[str, Sequence[str]],
    penalty: float = 1.0,
    moments: Mapping[int, Moments] | None = None,
    steps: int = 50,
    tolerance: float = 1e-9,
) -> list[Linear]:
    """Class-weighted logistic regression of every (feature set, fold) by joint Newton steps.

    One pass adds up loss, gradient and Hessian of all fits that have not converged. A step
    that raises a loss is halved. ``penalty`` acts on half the squared weights, not on the
    constant, next to the sum of weighted losses. Fits start from the linear discriminant, which
    the cross-products give without a pass, or from zero where that has the lower loss.
    """
    moments = moments or training_moments(f)
    w, light = f.width, _light(f)
    weights: dict[int, tuple[float, float]] = {}
    cells: dict[tuple[str, int], _Cell] = {}
    out = []
    for o, own in moments.items():
        ones = own.total[0, 2 + w]
        zeros = own.rows - ones
        for name in feature_sets:
            out.append(Linear(name, "DummyPrior", o, _logit(ones / own.rows), np.zeros(w)))
        if ones < 0.5 or zeros < 0.5:
            continue  # one class only: the baseline stands alone
        weights[o] = (own.rows / (2 * zeros), own.rows / (2 * ones))
        for name, features in feature_sets.items():
            d = design(f, own, o, features)
            cells[name, o] = _Cell(d, _discriminant(f, own, d, ones, zeros, penalty), own.rows * math.log(2.0))
    for _ in range(steps):
        active = {k: c for k, c in cells.items() if not c.done}
        if not active:
            break
        plan = [(name, o, c.design.transform, c.design.centre, c.beta) for (name, o), c in active.items()]
        sums = add_up(f, lambda b, plan=plan: _newton_sums(b, light, plan, weights))
        for (name, o), c in active.items():
            key, size = f"{name}|{o}|", len(c.beta)
            inner = penalty * np.append(np.ones(size - 1), 0.0)
            loss = float(sums[key + "loss"][0] + 0.5 * (inner * c.beta**2).sum())
            if c.last is None and not loss <= c.flat * (1 + 1e-9):
                c.beta = np.zeros(size)
                continue
            if c.last is not None and loss > c.loss * (1 + 1e-12):
                c.beta, c.move = (c.beta + c.last) / 2, math.inf
                c.done = np.abs(c.beta - c.last).max() < tolerance
                continue
            gradient = sums[key + "gradient"] + inner * c.beta
            hessian = sums[key + "hessian"].reshape(size, size) + np.diag(inner)
            move = np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]
            c.last, c.loss, c.beta = c.beta, loss, c.beta - move
            # Steps shrink as their squares near the end: the next one is foreseen, with a hundredfold margin.
            largest, before = float(np.abs(move).max()), c.move
            c.move = largest
            c.done = largest < tolerance or (largest < 0.05 * before < math.inf and 100 * largest**3 < tolerance * before**2)
    for (name, o), c in cells.items():
        d = c.design
        out.append(Linear(name, "LogisticRegression", o, float(c.beta[-1] - d.centre @ c.beta[:-1]), d.transform @ c.beta[:-1]))
    return out


def _discriminant(f: Frame, own: Moments, d: Design, ones: float, zeros: float, penalty: float) -> np.ndarray:
    """Weights and constant of the linear discriminant between both classes, which count alike."""
    w, n = f.width, own.rows
    of_ones = own.total[1 : 1 + w, 2 + w] @ d.transform - ones * d.centre  # standardised columns add up to zero
    one, zero = of_ones / ones, -of_ones / zeros
    within = (_centred(f, own, d)[0] - ones * np.outer(one, one) - zeros * np.outer(zero, zero) + penalty * np.eye(len(one))) / n
    weights = np.linalg.lstsq(within, one - zero, rcond=1e-9)[0]
    return np.append(weights, -weights @ (one + zero) / 2)


def _logit(share: float) -> float:
    if share <= 0.0 or share >= 1.0:
        return math.copysign(math.inf, share - 0.5)
    return math.log(share / (1 - share))


def _newton_sums(b: Block, f: Frame, plan: list, weights: Mapping[int, tuple[float, float]]) -> Sums:
    fold, z, m, context = _batch_arrays(b, f)
    label = b.label
    out: Sums = {}
    for o in sorted({p[1] for p in plan}):
        rest = fold != o
        raw = np.column_stack([z[rest], m[rest], context[rest, o - 1]])
        y = label[rest]
        weight = np.where(y == 1, weights[o][1], weights[o][0])
        for name, at, transform, centre, beta in plan:
            if at != o:
                continue
            used = np.flatnonzero(transform.any(axis=1))  # the set's own columns
            x = np.column_stack([raw[:, used] @ transform[used] - centre, np.ones(len(raw))])
            score = x @ beta
            p = 1.0 / (1.0 + np.exp(-np.clip(score, -700, 700)))
            key = f"{name}|{o}|"
            out[key + "loss"] = np.array([(weight * (np.logaddexp(0.0, score) - y * score)).sum()])
            out[key + "gradient"] = x.T @ (weight * (p - y))
            out[key + "hessian"] = (x * (weight * p * (1 - p))[:, None]).T @ x
    return out


# --------------------------------------------------------------------------
# Predictions
# --------------------------------------------------------------------------
def predict(f: Frame, models: Sequence[Linear], classify: bool = False) -> DataFrame:
    """Out-of-fold predictions: every row by the models of its own fold.

    One row per test, feature set and model, from one pass over the frame.
    """
    light = _light(f)
    by_fold = {
        o: (
            [m.feature_set for m in models if m.fold == o],
            [m.model for m in models if m.fold == o],
            np.array([m.constant for m in models if m.fold == o]),
            np.array([m.weights for m in models if m.fold == o]).reshape(-1, f.width),
        )
        for o in {m.fold for m in models}
    }
    names = ["_fold", "_id", "_required", "_y", "_label", *[f"_extra_{c}" for c in f.extra]]
    types = {r.name: r.dataType.elementType.simpleString() for r in f.rows.schema if r.name in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(_read(batch, light)):
                fold, z, m, context = _batch_arrays(b, light)
                rows = pa.RecordBatch.from_arrays([batch.column(c)[i].values for c in names], names)
                for o, (sets, kinds, constants, weights) in by_fold.items():
                    at = np.flatnonzero(fold == o)
                    if not len(at):
                        continue
                    raw = np.column_stack([z[at], m[at], context[at, o - 1]])
                    value = constants + raw @ weights.T
                    if classify:
                        with np.errstate(over="ignore"):  # a prior of 0 has the score minus infinity
                            value = 1.0 / (1.0 + np.exp(-value))
                    kept = rows.take(pa.array(np.repeat(at, len(sets))))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(sets * len(at)), pa.array(kinds * len(at)), pa.array(value.ravel())],
                        [*names, "FeatureSet", "Model", "_value"],
                    )

    ddl = ", ".join(f"`{c}` {types[c]}" for c in names) + ", FeatureSet string, Model string, _value double"
    long = f.rows.mapInArrow(run, ddl)
    head = [F.col("_fold").alias("Fold"), F.col("_id").alias("testId"), F.col("_required").alias("RequiredStrength28_psi"), "FeatureSet", "Model"]
    head += [F.col(f"_extra_{c}").alias(c) for c in f.extra]
    if classify:
        return long.select(*head, F.col("_label").alias(M.FAILED), F.col("_value").alias(M.SCORE))
    return long.select(*head, F.col("_y").alias(M.ACTUAL), F.col("_value").alias(M.PREDICTED))


# --------------------------------------------------------------------------
# Experiments
# --------------------------------------------------------------------------
def cross_validate_linear(
    rows: DataFrame, feature_sets: Mapping[str, Sequence[str]], folds: int = 5, penalties: Mapping[str, float] | None = None
) -> DataFrame:
    """Out-of-fold strength predictions of least squares, ridge and both baselines."""
    f = pack(rows, feature_sets, folds)
    return predict(f, fit_regressions(f, feature_sets, penalties or {"LinearRegression": 0.0, "Ridge": RIDGE_PENALTY}))


def cross_validate_logistic(rows: DataFrame, feature_sets: Mapping[str, Sequence[str]], folds: int = 5) -> DataFrame:
    """Out-of-fold failure probabilities of balanced logistic regression and the prior.

    Context is encoded with the failure rate.
    """
    f = pack(rows, feature_sets, folds, label=S.FAILURE)
    return predict(f, fit_logistic(f, feature_sets), classify=True)


def fold_summary(df: DataFrame, fold: str, target: str, group: str) -> DataFrame:
    """Rows, groups, mean and deviation of both sides of every fold, and both medians.

    The training side is all rows minus the fold: groups lie in one fold each, so counts of
    groups, rows, sums and squares are differences of totals.
    """
    y = F.col(target).cast("double")
    one = df.agg(F.avg(y)).scalar()
    shifted = df.withColumn("_d", y - F.coalesce(one, F.lit(0.0)))
    per_group = shifted.groupBy(fold, group).agg(
        F.count(F.lit(1)).alias("rows"), F.count("_d").alias("n"), F.sum("_d").alias("s"), F.sum(F.col("_d") * F.col("_d")).alias("q")
    )
    own = per_group.groupBy(fold).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "n", "s", "q")], F.count(F.lit(1)).alias("groups")
    )
    names = ("rows", "n", "s", "q", "groups")
    both = own.withColumn("_all", own.agg(F.struct(*[F.sum(c).alias(c) for c in names])).scalar()).withColumn("_mean", one)

    def mean(n, s):
        return F.col("_mean") + E.safe_div(s, n)

    def deviation(n, s, q):
        spread = F.greatest(q - E.safe_div(s * s, n), F.lit(0.0))
        return F.when(n > 1, F.sqrt(spread / (n - 1)))

    train = {c: F.col(f"_all.{c}") - F.col(c) for c in names}
    held = {c: F.col(c) for c in names}
    out = both.select(
        fold,
        train["rows"].alias("TrainRows"),
        held["rows"].alias("ValidationRows"),
        train["groups"].alias("TrainProjectGroups"),
        held["groups"].alias("ValidationProjectGroups"),
        mean(train["n"], train["s"]).alias("TrainTargetMean"),
        deviation(train["n"], train["s"], train["q"]).alias("TrainTargetStd"),
        mean(held["n"], held["s"]).alias("ValidationTargetMean"),
        deviation(held["n"], held["s"], held["q"]).alias("ValidationTargetStd"),
    )
    medians = leave_out_quantiles(df.withColumn("_key", F.lit(0)), ["_key"], fold, target, {"TrainTargetMedian": 0.5}).drop("_key")
    return out.join(medians, fold, "left")
