"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens get log-odds with an informative Dirichlet prior from labelled texts. A linear scan
finds all maximal scoring segments of a text, and the extreme-value distribution of the
best segment of ordinary text of the same length turns their scores into significance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import durable, fold_of, prepare

#: At most about this many labelled rows of each class are fitted, those with the smallest hashes.
FIT_ROWS = 6000
#: A token enters the model if its log-odds lie this many deviations from zero ...
KEEP_Z = 3.0
#: ... and at most this many tokens do, the most significant first (a bound of the model's size).
MAX_TOKENS = 50_000
#: Search factor of the extreme-value law; segments cannot start everywhere independently.
SEARCH = 0.1
STRIP = bytes(32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else b for b in range(256))


class Model(NamedTuple):
    weight: dict[bytes, float]  # score of each model token
    drift: float  # score of every other token, below zero
    decay: float  # lambda of the extreme-value law
    slope: float  # of the final logistic step over significance
    offset: float


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII bytes."""
    return (text or "").lower().encode().translate(STRIP).split()


def segments(scores: list[tuple[int, float]], n: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) of n tokens in linear time.

    ``scores`` holds the tokens that differ from ``drift`` as (position, score). Stretches
    between them fall evenly, so only scored positions are visited. Every segment kept is
    one whose every prefix and suffix is positive and that no larger such segment contains.
    """
    stack: list[tuple[int, int, float, float]] = []  # start, stop, sum before, sum after
    total, last = 0.0, 0
    for at, s in scores:
        total += (at - last) * drift
        last = at + 1
        low, total = total, total + s
        if s <= 0:
            continue
        start, stop, high = at, at + 1, total
        while stack:
            # The nearest earlier segment that begins lower.
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= high:
                break
            start, _, low, _ = stack[k]
            del stack[k:]
        stack.append((start, stop, low, high))
    return [(a, b, high - low) for a, b, low, high in stack]


def significance(found: list[tuple[int, int, float]], n: int, decay: float) -> float:
    """Log of 1 / E of the best segment: lambda S - ln(K n), with the sum over all significant segments.

    Without a segment it is -ln(1 + n), which is below that of any segment.
    """
    if not found:
        return -math.log(1 + n) - 5.0
    floor = math.log(SEARCH * n + 1)
    good = [decay * s - floor for _, _, s in found]
    best = max(good)
    return best + sum(g for g in good if g > 0) - max(best, 0)


def solve_decay(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1; 1 if scores cannot be positive."""
    if not len(scores) or scores.max() <= 0 or float(shares @ scores) >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    f = lambda x: float(shares @ np.exp(np.minimum(x * scores, 700))) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, copies: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge-damped logistic curve (Newton steps), slope at least 0."""
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = copies * (p * (1 - p) + 1e-9)
        g = np.array([(copies * (y - p) * x).sum() - 1e-2 * a, (copies * (y - p)).sum() - 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    return max(a, 0.0), b


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of about ``FIT_ROWS`` labelled ids of each class, fixed by a hash of the id.

    Ids are chosen before any text is read, and the chosen ids, whose number that bound
    limits, are sent to the documents.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").distinct()
    pairs = marked.join(docs.select("doc_id").distinct(), "doc_id")
    counts = {r["toxic"]: r["count"] for r in pairs.groupBy("toxic").count().collect()}
    if not counts:
        return docs.select("text", F.lit(0).alias("toxic")).limit(0)
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, FIT_ROWS / n))]), F.col("toxic"))
    unit = F.xxhash64("doc_id", F.lit(2)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    chosen = F.broadcast(durable(pairs.filter(unit < share)))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic")


def _spread(texts: DataFrame) -> DataFrame:
    """toxic, token rows, counted within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, text = (c.to_pylist() for c in batch.columns)
            counts: dict[tuple[int, bytes], int] = {}
            for y, t in zip(toxic, text):
                for w in tokens_of(t):
                    counts[y, w] = counts.get((y, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([y for y, _ in counts], pa.int32()), pa.array([w for _, w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["toxic", "token", "n"],
            )

    return texts.select("toxic", "text").mapInArrow(run, "toxic int, token binary, n bigint")


def log_odds(counts: DataFrame, toxic_total: int, clean_total: int) -> DataFrame:
    """Adds ``odds`` and ``z`` to tokens with counts ``t`` and ``c``.

    The prior of a token is its share of all tokens, weighing as much as the smaller class,
    so a token with the same rate in both classes keeps odds of 0 however rare it is.
    """
    weight = min(toxic_total, clean_total)
    prior = (F.col("t") + F.col("c")) * (weight / (toxic_total + clean_total))
    a, b = F.col("t") + prior, F.col("c") + prior
    odds = F.ln(a / (toxic_total + weight + 1 - a)) - F.ln(b / (clean_total + weight + 1 - b))
    return counts.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))


def fit(labelled: DataFrame) -> Model | None:
    """Learn from rows (text, toxic 0/1), usually a ``sample``. None without rows of both classes.

    What reaches the driver is bounded: class totals, at most ``MAX_TOKENS`` significant tokens, and a histogram of rounded sample scores.
    """
    rows = durable(labelled.select("text", F.col("toxic").cast("int").alias("toxic")).filter("text IS NOT NULL AND toxic IN (0, 1)"))
    long = durable(
        _spread(rows).groupBy("token")
        .agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c"))
    )
    sums = long.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    toxic_total, clean_total = sums["t"] or 0, sums["c"] or 0
    if not toxic_total or not clean_total:
        return None
    chosen = (
        log_odds(long, toxic_total, clean_total).filter(F.abs("z") >= KEEP_Z)
        .orderBy(F.abs("z").desc(), "token").limit(MAX_TOKENS).collect()
    )
    weight = {bytes(r["token"]): float(r["odds"]) for r in chosen}
    t = np.array([r["t"] for r in chosen], float)
    c = np.array([r["c"] for r in chosen], float)
    s = np.array([r["odds"] for r in chosen], float)
    # What is left falls by its own log-ratio, but at least a little: long texts drift down.
    rest_t, rest_c = max(toxic_total - t.sum(), 1.0) / toxic_total, max(clean_total - c.sum(), 1.0) / clean_total
    drift = min(math.log(rest_t / rest_c), -0.02)
    shares = np.append((c + 0.5) / (clean_total + 0.5 * (len(c) + 1)), 0.0)
    shares[-1] = max(1 - shares.sum(), 0.0)
    decay = solve_decay(shares, np.append(s, drift))
    model = Model(weight, drift, decay, 1.0, 0.0)
    cells = (
        _scored(rows, model, ["toxic"]).select("toxic", F.round(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("x"))), 1).alias("x"))
        .groupBy("toxic", "x").count().collect()
    )
    x, y, n = (np.array([float(r[k]) for r in cells]) for k in ("x", "toxic", "count"))
    slope, offset = _logistic(x, y, n)
    return model._replace(slope=slope, offset=offset)


def _scored(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the significance ``x`` and the significant ``passages`` (token positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, drift, decay = model.weight.get, model.drift, model.decay
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            x, passages = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                words = tokens_of(t)
                hits = [(k, s) for k, s in enumerate(map(get, words)) if s is not None]
                found = segments(hits, len(words), drift)
                x.append(significance(found, len(words), decay))
                floor = math.log(SEARCH * len(words) + 1)
                passages.append([{"start": a, "stop": b, "score": s} for a, b, s in found if decay * s > floor])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(x, pa.float64()), pa.array(passages, kind)], names=[*keep, "x", "passages"]
            )

    prepare(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}x double, passages array<struct<start:int,stop:int,score:double>>")


def score(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``score`` (0 to 1), ``predicted`` and ``passages`` for every row.

    NULL and empty texts score as texts without a segment. Without a model every score is 0.
    Repeated rows repeat; an empty table stays empty.
    """
    if model is None:
        none = F.array().cast("array<struct<start:int,stop:int,score:double>>")
        return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), none.alias("passages"))
    p = 1 / (1 + F.exp(-(F.col("x") * F.lit(model.slope) + F.lit(model.offset))))
    return (
        _scored(df, model, list(keep), text).withColumn("score", p)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*[F.col(f"`{c}`") for c in keep], "score", "predicted", "passages")
    )


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled rows of four of five folds of the ids, score all rows; a NULL id is never held out.

    Labels with a NULL ``toxic`` are not used. If an id bears several labels each counts once.
    """
    prepare(docs.sparkSession)
    fold = F.coalesce(fold_of(F.col("doc_id")), F.lit(1))
    model = fit(sample(docs.filter(fold != 0), labels))
    return score(docs, model).select("doc_id", (F.coalesce(fold_of(F.col("doc_id")), F.lit(1)) == 0).alias("held_out"), "score", "predicted")
