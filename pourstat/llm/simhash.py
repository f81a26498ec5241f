"""SimHash near-duplicates: pivot distance tables over banded fingerprints.

Distinct fingerprints are compared within cells that agree on some bit blocks, which every
pair within reach shares at least once. Inside a cell, distances to reference fingerprints
(pivots) are tabled: by the triangle inequality a pair within reach differs by at most the
reach in every coordinate, so the cell is sorted by one coordinate, walked in a window, and
thinned by the others before the few survivors are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pourstat.llm.common import durable, prepare
from pourstat.llm.graph import components

REACH = 4
SHINGLE = 4
SEED = 42
PIVOTS = 16
#: Cells up to this many fingerprints are compared in one task; larger ones use finer blocks.
CELL = 4096
#: Fingerprints that should meet in a cell on average when the first block table is chosen.
CROWD = 64
#: Shingles whose bits are added up at once.
SLICE = 1 << 15


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of four-word shingles, as a signed number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, SLICE):
        hashes = [digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(lo, min(n, lo + SLICE))]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">i8")[0])


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``fp`` for every row; NULL and wordless texts have fingerprint 0."""
    prepare(df.sparkSession)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], names=[*names, "fp"])

    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}fp bigint")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, evenly mixed 64-bit numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(count)], np.uint64)


def cell_links(fps: np.ndarray, table: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all pairs of a cell within reach, as a forest.

    ``table`` holds the distances of each fingerprint to the pivots.
    """
    n = len(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order].astype(np.int16)
    ends = np.searchsorted(table[:, 0], table[:, 0] + reach, side="right")
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    joined: list[tuple[int, int]] = []
    for i in range(n - 1):
        lo, hi = i + 1, int(ends[i])
        if lo >= hi:
            continue
        near = np.flatnonzero((np.abs(table[lo:hi, 1:] - table[i, 1:]) <= reach).all(axis=1)) + lo
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= reach]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                joined.append((i, j))
    if not joined:
        return fps[:0], fps[:0]
    pairs = np.array(joined)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def masks(level: int, reach: int = REACH) -> list[int]:
    """Bit masks of the ``level`` blocks out of ``level + reach`` that a cell agrees on."""
    edges = [round(64 * k / (level + reach)) for k in range(level + reach + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = [sum(block[i] for i in chosen) for chosen in combinations(range(level + reach), level)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _compare(cells: DataFrame) -> DataFrame:
    """Links of all cells (column ``fps``)."""
    reference = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.bitwise_count(flat[:, None] ^ reference).astype(np.uint8)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            found = [cell_links(flat[a:b], table[a:b]) for a, b in zip(at, at[1:])]
            a, b = (np.concatenate([np.zeros(0, np.uint64), *[x[k] for x in found]]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cells.select("fps").mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, reach: int = REACH) -> DataFrame:
    """Links (a, b) over distinct fingerprints ``fp`` that connect every pair within reach.

    The first block table is chosen so that cells stay small on average. Fingerprints of a
    cell that still holds more than ``CELL`` are compared by the next, finer table, where
    they share a cell again; what the finest table leaves crowded is cut into blocks that
    are compared pairwise. No pair is lost at any size.
    """
    rest = durable(distinct.select("fp").distinct())
    n = rest.count()
    level = 1
    while level < 4 and n > CROWD << (64 * level // (level + reach)):
        level += 1
    out = None
    while n:
        keyed = rest.select(
            "fp",
            F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks(level, reach))])).alias("c"),
        ).select("fp", "c.t", "c.k")
        crowded = durable(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > CELL))
        hot = crowded.count()
        calm = keyed.join(crowded.select("t", "k"), ["t", "k"], "left_anti") if hot else keyed
        cells = calm.groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        found = _compare(cells)
        out = found if out is None else out.union(found)
        if not hot:
            break
        left = keyed.join(crowded, ["t", "k"])
        if level == 4:
            blocks = F.ceil(F.col("n") / (CELL // 2)).cast("int")
            mine = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")
            dealt = left.withColumn("n_blocks", blocks).withColumn("mine", mine).select(
                "t", "k", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
            )
            pairs = dealt.groupBy("t", "k", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
            out = out.union(_compare(pairs.agg(F.collect_list("fp").alias("fps"))))
            break
        rest, level = durable(left.select("fp").distinct()), level + 1
    return out if out is not None else distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)


def _rooted(df: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, DataFrame]:
    """Columns ``keep`` and ``fp`` for every row, and ``fp, first, root``: smallest id and component of every fingerprint."""
    rows = durable(fingerprints(df, keep, text))
    first = rows.groupBy("fp").agg(F.min(f"`{keep[0]}`").alias("first"))
    comp = components(links(first)).select(F.col("node").alias("fp"), "root")
    return rows, durable(first.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` (first the id), ``fp`` and ``component_id`` for every row.

    Rows are linked if their fingerprints differ in at most ``REACH`` bits; the component is
    the smallest id reachable, NULL ids aside. NULL and wordless texts share fingerprint 0 and are
    linked like any other. Repeated rows stay and share a component. Copies are folded to
    one fingerprint before anything is compared.
    """
    rows, rooted = _rooted(df, keep, text)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    label = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(label, "fp", "left").select(*[F.col(f"`{c}`") for c in keep], "fp", "component_id")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def text_hash(text: str = "text"):
    """SHA-256 of a text, which stands for the text where rows are told apart; NULL counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256))


def first_place():
    """Smallest (id, th) of a part of a group, NULL ids aside."""
    return F.min(F.when(F.col("id").isNotNull(), F.struct("id", "th"))).alias("f")


def first_of_groups(df: DataFrame, rooted: DataFrame, ident: str) -> DataFrame:
    """The row with the smallest id, then the smallest text hash, of each group, and rows with a NULL id.

    ``rooted`` has ``f`` and ``root`` for parts of the groups; ``f`` is the part's smallest ``first_place``.
    Of rows equal in id and text one stays. The row travels as a struct, so its columns may have any names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    least = rooted.filter("f IS NOT NULL").groupBy("root").agg(F.min("f").alias("f"))
    chosen = least.select(F.col("f.id").alias("first_id"), F.col("f.th").alias("first_th"))
    rows = df.select(whole.alias("whole"), F.col(f"`{ident}`").alias("id"), text_hash().alias("th"))
    named = rows.join(chosen, (F.col("id") == F.col("first_id")) & (F.col("th") == F.col("first_th")), "left_semi")
    order = Window.partitionBy("id", "th").orderBy("th")
    once = named.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return once.select("whole.*").union(rows.filter("id IS NULL").select("whole.*"))


def keep_representatives(df: DataFrame, ident: str = "doc_id") -> DataFrame:
    """One row of each component: the one with the smallest id, of repeated ids the smallest text hash.

    A NULL id cannot be named by a component, so such rows stay.
    """
    hashed = df.select(F.col(f"`{ident}`").alias("id"), text_hash().alias("th"), "text")
    rows, rooted = _rooted(hashed, ("id", "th"), "text")
    parts = rows.groupBy("fp").agg(first_place())
    return first_of_groups(df, parts.join(rooted, "fp").select("f", "root"), ident)
