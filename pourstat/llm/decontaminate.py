"""Benchmark decontamination with spaced seeds.

A seed hashes the words at the set positions of a fixed mask, so a substituted word at an
unset position does not hide a match. Seed hashes of documents and benchmark items are
joined, and the alignment of every hit is verified word by word. DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import durable, settled

#: Positions that count; masks of different shape miss different substitutions.
MASKS = ("1101011", "11001101")
#: An overlap is a leak if, in some stretch of WINDOW aligned words, at least this share agrees.
WINDOW = 13
SHARE = 0.8
#: Largest bit table that is sent along with the plan. Beyond it the table only filters less.
MAX_BITS = 1 << 22
#: Up to this many keys of hit rows (8 bytes each) may be broadcast; more are joined by shuffle.
MAX_BROADCAST_KEYS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; everything but letters and digits separates."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(words, at + k) for k, bit in enumerate(mask) if bit == "1"])


def _positions(words: Column, mask: str) -> Column:
    last = F.size(words) - len(mask)
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last))


def item_seeds(items: DataFrame) -> DataFrame:
    """``item_id, words, seed, at`` for every mask and position. Items shorter than a mask have no seed."""
    words = items.select("item_id", word_hashes(F.col("text")).alias("words"))
    w = F.col("words")

    def of(mask: str, number: int) -> Column:
        return F.transform(_positions(w, mask), lambda i: F.struct(_seed(w, i, mask, number).alias("seed"), i.alias("at")))

    seeds = F.concat(*[of(m, n) for n, m in enumerate(MASKS)])
    return words.withColumn("s", F.explode_outer(seeds)).filter("s IS NOT NULL").select("item_id", "words", "s.seed", "s.at")


def seed_table(seeds: DataFrame) -> np.ndarray:
    """One bit per seed hash in a table of at most ``MAX_BITS`` bits, as signed 64-bit words."""
    n = seeds.count()
    bits = 4096
    while bits < 32 * n and bits < MAX_BITS:
        bits *= 2
    cell = F.col("seed").bitwiseAND(F.lit(bits - 1))
    words = (
        seeds.select(F.shiftright(cell, 6).alias("k"), F.pmod(cell, F.lit(64)).cast("int").alias("b")).distinct()
        .select("k", F.expr("shiftleft(1L, b)").alias("v")).groupBy("k").agg(F.bit_or("v").alias("v")).collect()
    )
    table = np.zeros(bits // 64, np.int64)
    for r in words:
        table[r["k"]] = r["v"]
    return table


def _listed(seed: Column, table: Column, bits: int) -> Column:
    cell = seed.bitwiseAND(F.lit(bits - 1))
    return F.getbit(F.get(table, F.shiftright(cell, 6).cast("int")), F.pmod(cell, F.lit(64)).cast("int")) == 1


def hits(docs: DataFrame, seeds: DataFrame, text: str = "text") -> DataFrame:
    """``key, words, item_id, item, shift`` of every alignment on which some seed matches.

    Positions whose seed the bit table does not list are dropped inside the row, so nothing
    but candidates is exploded or shuffled; the join with the seeds decides.
    """
    table = seed_table(seeds)
    bits, literal = 64 * len(table), F.lit(table)
    rows = docs.select(F.col("_key").alias("key"), word_hashes(F.col(text)).alias("words"))
    w = F.col("words")

    def of(mask: str, number: int) -> Column:
        listed = F.filter(_positions(w, mask), lambda i: _listed(_seed(w, i, mask, number), literal, bits))
        return F.transform(listed, lambda i: F.struct(_seed(w, i, mask, number).alias("seed"), i.alias("i")))

    found = F.concat(*[of(m, n) for n, m in enumerate(MASKS)])
    # An outer generator keeps the optimiser from testing the array a second time.
    listed = rows.select("key", "words", F.explode_outer(found).alias("h")).filter("h IS NOT NULL")
    single = listed.select("key", "words", "h.seed", "h.i")
    met = single.join(seeds.withColumnRenamed("words", "item"), "seed")
    return met.select("key", "words", "item_id", "item", (F.col("i") - F.col("at")).alias("shift"))


def _agreements(words: Column, item: Column, shift: Column) -> Column:
    """0/1 for every aligned word pair of an item laid over a text at ``shift``."""
    lo = F.greatest(F.lit(0), -shift)
    hi = F.least(F.size(item), F.size(words) - shift) - 1
    return F.transform(F.sequence(lo, hi), lambda j: (F.get(item, j) == F.get(words, j + shift)).cast("int"))


def overlaps(found: DataFrame) -> DataFrame:
    """Adds ``n_aligned``, ``n_agree`` and ``best`` (most agreeing words in a stretch) per alignment."""
    one = found.withColumn("eq", _agreements(F.col("words"), F.col("item"), F.col("shift")))
    eq = F.col("eq")
    span = F.least(F.lit(WINDOW), F.size("item"))
    # Sums over stretches come from prefix sums; a stretch has to fit the aligned part.
    sums = F.aggregate(eq, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    two = one.withColumn("sums", sums).withColumn("span", span)
    s = F.col("sums")
    best = F.when(F.size("eq") < F.col("span"), F.lit(0)).otherwise(
        F.array_max(F.transform(F.sequence(F.col("span"), F.size("eq")), lambda j: F.get(s, j) - F.get(s, j - F.col("span"))))
    )
    return two.select(
        "key", "item_id", "span", F.size("eq").cast("long").alias("n_aligned"),
        F.element_at(s, -1).cast("long").alias("n_agree"), best.alias("best"),
    )


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``key, item_id, n_aligned, n_agree`` of every (row, item) that leaks; docs bear ``_key``."""
    seeds = durable(item_seeds(items.select("item_id", "text")))
    verified = overlaps(hits(docs, seeds, text).dropDuplicates(["key", "item_id", "shift"]))
    leak = settled(verified, "best").filter(F.col("best") >= F.ceil(F.col("span") * SHARE))
    return durable(
        leak.groupBy("key", "item_id").agg(F.max(F.struct("n_agree", "n_aligned")).alias("m"))
        .select("key", "item_id", F.col("m.n_aligned").alias("n_aligned"), F.col("m.n_agree").alias("n_agree"))
    )


def keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Rows with a key of id and text; equal rows share it."""
    return docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(ident).cast("string"), F.lit("null")), F.col(text)))


def _near(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys


def leaks(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_aligned, n_agree``: one row for every document and benchmark item it leaks.

    An item shorter than ``WINDOW`` words is judged over its own length; one shorter than
    every mask cannot be found. NULL and empty texts leak nothing; repeated documents
    each get their rows; items that repeat under one id count once; an empty table on either
    side gives an empty result.
    """
    rows = keyed(docs.select(ident, text), ident, text)
    found = contaminated(rows, items, text)
    return rows.select(ident, "_key").join(_near(found), F.col("_key") == F.col("key")).select(ident, "item_id", "n_aligned", "n_agree")


def drop_leaks(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that leak no item, with their own columns, whatever their names.

    NULL and empty texts leak nothing, repeated rows get the same verdict, an empty table stays empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = keyed(docs.select(whole, F.col(f"`{ident}`").alias("ident"), F.col(f"`{text}`").alias("body")), "ident", "body")
    found = contaminated(rows.select("_key", "body"), items, "body").select(F.col("key").alias("_leak")).distinct()
    return rows.join(_near(durable(found)), F.col("_key") == F.col("_leak"), "left_anti").select("whole.*")
