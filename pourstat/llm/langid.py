"""Language identification in two steps: family, then one-versus-one machines within it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import durable, fold_of, prepare

#: Language families by ISO 639-1 code. A code outside the table forms the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "es fr it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt am",
    "cjk": "zh ja ko",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Hashed letter n-grams.
BUCKETS = 2048
#: At most about this many training texts of each language are fitted, those with the smallest hashes.
FIT_ROWS = 1500
UNDEFINED = "und"


def features(text: str | None) -> np.ndarray | None:
    """Shares of hashed 1-, 2- and 3-grams of the lower-cased UTF-8 letters; None without letters.

    ASCII characters that are no letters count as one space; the whole text is read.
    """
    if not text or not any(map(str.isalpha, text)):
        return None
    x = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    x[(x < 97) | ((x > 122) & (x < 128))] = 32
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - int(math.log2(BUCKETS)))
    counts = np.bincount((x * np.uint32(0x9E3779B1)) >> shift, minlength=BUCKETS).astype(np.float64)
    counts += np.bincount((two * np.uint32(0x2C1B3C6D)) >> shift, minlength=BUCKETS)
    counts += np.bincount((three * np.uint32(0x297A2D39)) >> shift, minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


class Machine(NamedTuple):
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


class Model(NamedTuple):
    families: list[str]
    members: dict[str, list[str]]
    family_machines: list[Machine]  # one against the rest, in the order of families; a single one for two
    pair_machines: dict[tuple[str, str], Machine]  # positive margin: the first language


def _vectors(df: DataFrame) -> DataFrame:
    """Columns lang and x: the features of every text that has letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, text = batch.columns
            rows = [(a, f) for a, t in zip(lang.to_pylist(), text.to_pylist()) if (f := features(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.list_(pa.float64()))],
                names=["lang", "x"],
            )

    return df.select("lang", "text").mapInArrow(run, "lang string, x array<double>")


def _fit(rows: DataFrame, positive: list[str]) -> Machine:
    data = rows.select(F.col("lang").isin(*positive).cast("double").alias("label"), array_to_vector("x").alias("features"))
    fitted = LinearSVC(maxIter=25, regParam=1e-3, standardization=False).fit(data)
    return Machine(fitted.coefficients.toArray(), float(fitted.intercept))


def fit(df: DataFrame) -> Model | None:
    """Learn from rows with text and language; about ``FIT_ROWS`` texts of each language.

    The sample is fixed by a hash of the text, so repeated texts are in or out together. None
    if no row can be used. Only counts by language and fitted weights reach the driver.
    """
    usable = df.select("lang", "text").filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, FIT_ROWS / n))]), F.col("lang"))
    unit = (F.xxhash64("text", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    rows = durable(_vectors(usable.filter(unit < share)))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    members: dict[str, list[str]] = {}
    for lang in sorted(counts):
        members.setdefault(FAMILY_OF.get(lang, "other"), []).append(lang)
    families = sorted(members)
    tops = families[:1] if len(families) == 2 else families if len(families) > 2 else []
    return Model(
        families,
        members,
        [_fit(rows, members[f]) for f in tops],
        {(a, b): _fit(rows.filter(F.col("lang").isin(a, b)), [a]) for f in families for a, b in combinations(members[f], 2)},
    )


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))


def predict_many(model: Model, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of feature rows: family first, then votes of its pairs.

    Equal votes are settled by the summed margins, then by alphabet.
    """
    n = len(x)
    if len(model.families) == 1:
        family, sure = np.zeros(n, int), np.ones(n)
    elif len(model.families) == 2:
        m = model.family_machines[0].margin(x)
        family, sure = (m < 0).astype(int), _sigmoid(np.abs(m))
    else:
        m = np.stack([f.margin(x) for f in model.family_machines], axis=1)
        family, sure = m.argmax(axis=1), _sigmoid(m.max(axis=1))
    langs, score = [""] * n, np.zeros(n)
    for k, name in enumerate(model.families):
        at = np.flatnonzero(family == k)
        who = model.members[name]
        votes, total, best = np.zeros((len(at), len(who))), np.zeros((len(at), len(who))), np.ones((len(at), len(who)))
        for a, b in combinations(range(len(who)), 2):
            m = model.pair_machines[who[a], who[b]].margin(x[at])
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            total[:, a] += m
            total[:, b] -= m
            best[:, a] = np.minimum(best[:, a], _sigmoid(m))
            best[:, b] = np.minimum(best[:, b], _sigmoid(-m))
        order = votes + 1e-6 * np.tanh(total)
        pick = order.argmax(axis=1)
        for row, p in zip(at.tolist(), pick.tolist()):
            langs[row] = who[p]
        score[at] = sure[at] * best[np.arange(len(at)), pick]
    return langs, score


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` of every row; only the text is looked at.

    NULL texts and texts without letters, and all texts if nothing could be learned, get
    ``und`` with score 0. Repeated rows get repeated answers.
    """
    prepare(df.sparkSession)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            at = [k for k, f in enumerate(got) if f is not None]
            langs, score = [UNDEFINED] * len(got), np.zeros(len(got))
            if model is not None and at:
                found, sure = predict_many(model, np.stack([got[k] for k in at]))
                score[at] = sure
                for k, lang in zip(at, found):
                    langs[k] = lang
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}lang_pred string, score double")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Fit on four of five folds of the ids, predict all rows; a NULL id is a training row."""
    fold = F.coalesce(fold_of(F.col("doc_id")), F.lit(1))
    model = fit(docs.filter(fold != 0))
    return identify(docs, model).select("doc_id", (F.coalesce(fold_of(F.col("doc_id")), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score")
