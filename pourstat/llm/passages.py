"""Near-duplicate passages: paragraph MinHash banding, exact Jaccard, components.

Paragraphs are lines. Their five-word shingles are min-hashed and banded, paragraphs that
collide in a band are verified by exact Jaccard similarity, and components of verified links
are reduced to their first occurrence. A passage that sits inside a larger paragraph is
found by its sentences, which are matched exactly.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import checkpoint_dir, identified, prepare, stored
from pourstat.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.994.
ROWS, BANDS = 2, 5
#: Paragraphs of a band bucket that are compared in one task; larger buckets are cut in blocks.
BUCKET = 1024

LINE = re.compile(r"[^\n]+")
#: A sentence ends with a mark before white space; a long run of words without one ends at a hashed word.
ENDS = (".", "!", "?", "。", "！", "？")
LONG = 16
_A = np.array([xxhash.xxh64_intdigest(b"a%d" % i) | 1 for i in range(ROWS * BANDS)], np.uint64)
_P = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(SHINGLE)]


def word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    out = []
    for w in words:
        k = known.get(w)
        if k is None:
            if len(known) > 400_000:
                known.clear()
            k = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(k)
    return np.array(out, np.uint64)


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of all five-word windows."""
    n = len(ids) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    x = sum((ids[i : i + n] * _P[i] for i in range(SHINGLE)), np.zeros(n, np.uint64))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bands(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Band keys (lines x BANDS) of consecutive lines with ``size`` words each, all of five or more."""
    sh = shingles(ids)
    ends = np.cumsum(size)
    # Windows that run over a line's end are left out.
    inside = np.ones(len(sh), bool)
    for k in range(1, SHINGLE):
        inside[ends[:-1] - k] = False
    sh = sh[inside]
    count = size - SHINGLE + 1
    mixed = sh[None, :] * _A[:, None] ^ (sh >> np.uint64(17))[None, :] * _A[::-1, None]
    least = np.minimum.reduceat(mixed, np.cumsum(count) - count, axis=1)
    keys = np.zeros((BANDS, len(size)), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ least[r * BANDS : (r + 1) * BANDS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return (keys ^ _A[:BANDS, None]).T.copy().view(np.int64)


def sentences(words: list[str]) -> list[tuple[int, int]]:
    """Word ranges of a line's sentences; one with under five words is joined to the next.

    A cut depends on where the cut before it lies, so a passage inside a longer line without
    sentence marks may be cut differently from its copy.
    """
    out, a = [], 0
    for i, w in enumerate(words):
        if (w.endswith(ENDS) and i + 1 - a >= SHINGLE) or (i + 1 - a >= LONG and xxhash.xxh3_64_intdigest(w) % 8 == 0):
            out.append((a, i + 1))
            a = i + 1
    if len(words) - a >= SHINGLE:
        out.append((a, len(words)))
    return out


def units(text: str | None) -> Iterator[tuple[bool, int, int, list[str]]]:
    """(is a line, start, stop, words) of all units with five words or more; places in code points."""
    for m in LINE.finditer(text or ""):
        found = [(w.start() + m.start(), w.end() + m.start(), w.group()) for w in re.finditer(r"[^\x20\x09-\x0D]+", m.group())]
        if len(found) < SHINGLE:
            continue
        words = [w for _, _, w in found]
        yield True, found[0][0], found[-1][1], words
        # A line of one sentence is also a sentence: the same words may stand inside another line.
        for a, b in sentences(words):
            yield False, found[a][0], found[b - 1][1], words[a:b]


_UNITS = "doc bigint, th bigint, line boolean, start int, stop int, n_words int, e bigint, bands array<bigint>"


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = ["doc", "th", "line", "start", "stop", "n_words", "e", "bands"]
    for batch in batches:
        rows = []
        for doc, th, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines = []
            for line, start, stop, words in units(text):
                plain = " ".join(words).encode().lower()
                e = xxhash.xxh3_64_intdigest(plain, int(line)) - (1 << 63)
                rows.append((doc, th, line, start, stop, len(words), e, None))
                if line:
                    lines.append((len(rows) - 1, plain.split(b" ")))
            if lines:
                ids = word_ids([w for _, ws in lines for w in ws], known)
                keys = bands(ids, np.array([len(ws) for _, ws in lines]))
                for (k, _), band in zip(lines, keys.tolist()):
                    rows[k] = (*rows[k][:-1], band)
        columns = list(zip(*rows)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of chosen places of a text."""
    known: dict[bytes, int] = {}
    for batch in batches:
        e, sets = [], []
        for text, places in zip(*(c.to_pylist() for c in batch.columns)):
            for p in places:
                words = text[p["start"] : p["stop"]].encode().lower().split()
                e.append(p["e"])
                sets.append(np.unique(shingles(word_ids(words, known))).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["e", "sh"])


def bucket_links(keys: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all pairs of a bucket with Jaccard similarity of at least ``SIMILARITY``, as a forest.

    Shared shingles of a set with all sets before it are counted through an index of the
    bucket's shingles; pairs that are already connected are passed over.
    """
    n = len(keys)
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(code, kind="stable")
    holders = owner[order]
    begin = np.searchsorted(code[order], np.arange(int(code.max()) + 2 if len(code) else 1))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, at = [], np.cumsum(size) - size
    for i in range(1, n):
        mine = code[at[i] : at[i] + size[i]]
        shared = np.zeros(n, np.int64)
        for c in mine.tolist():
            shared[holders[begin[c] : begin[c + 1]]] += 1
        near = np.flatnonzero(shared[:i] >= SIMILARITY * (size[:i] + size[i] - shared[:i]) - 1e-9)
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                out.append((keys[i], keys[j]))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[int, int]] = []
        for members in batch.column(0).to_pylist():
            members.sort(key=lambda m: m["e"])
            found += bucket_links([m["e"] for m in members], [np.array(m["sh"], np.int64) for m in members])
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def paragraph_links(rows: DataFrame, contents: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) between different line contents that are near-duplicates.

    ``contents`` has one row per content ``e`` with its first place and its bands. Buckets with
    one content are settled. Shingle sets are made for contents of larger buckets only. A
    bucket of more than ``BUCKET`` contents is cut into blocks that are compared pairwise; no
    pairs are emitted but a forest per block pair.
    """
    keyed = contents.select("e", F.explode("bands").alias("k"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(keyed.join(shared, "k"), folder, "buckets")
    wanted = met.select("e").distinct().join(contents.drop("bands"), "e")
    places = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("e", "start", "stop")).alias("places"))
    sets = rows.join(places, ["doc", "th"]).select("text", "places").mapInArrow(_shingle_rows, "e bigint, sh array<bigint>")
    blocks = F.ceil(F.col("n") / (BUCKET // 2)).cast("int")
    mine = F.when(F.col("n") > BUCKET, F.pmod(F.xxhash64("e"), blocks)).otherwise(F.lit(0)).cast("int")
    last = F.when(F.col("n") > BUCKET, blocks - 1).otherwise(F.lit(0))
    dealt = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    block = dealt.select("k", "e", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    full = block.join(stored(sets, folder, "sets"), "e").groupBy("k", "p", "q").agg(F.collect_list(F.struct("e", "sh")).alias("m"))
    return full.select("m").mapInArrow(_verify, "a bigint, b bigint")


def repeated_passages(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, stop, n_words, unit, keep_doc_id, keep_start``: one row for every passage to remove.

    A passage is a line, or a sentence inside one, of at least five words; places are code
    points. A line of one sentence is both; it has one row, or two that name different firsts. It is removed if an earlier passage (smaller id, or before it in the text) has
    the same words in lower case, or, for lines, belongs to the same component of five-word
    Jaccard similarity of ``SIMILARITY`` or more. ``keep_`` names the component's first. NULL
    and empty texts have no passages; NULL ids come last; rows equal in id and text count as
    one document and are not compared with each other. An empty table gives an empty result.
    """
    spark = df.sparkSession
    prepare(spark)
    folder = f"{checkpoint_dir(spark)}/passages-{uuid.uuid4().hex}"
    rows = identified(df, ident, text)
    found = stored(rows.select("doc", "th", "text").mapInArrow(_unit_rows, _UNITS), folder, "units")
    place = F.struct("doc", "th", "start", "stop")
    lines = found.filter("line").groupBy("e").agg(F.min(place).alias("f"), F.first("bands").alias("bands"))
    contents = stored(lines.select("e", "f.doc", "f.th", "f.start", "f.stop", "bands"), folder, "contents")
    linked = stored(components(paragraph_links(rows.select("doc", "th", "text"), contents, folder)), folder, "components")
    # Classes with more than one place: linked contents, and contents that repeat.
    first = found.groupBy("e").agg(F.min(F.struct("doc", "th", "start")).alias("f"), F.count("*").alias("n"))
    classed = first.join(linked.withColumnRenamed("node", "e"), "e", "left").filter("n > 1 OR root IS NOT NULL")
    classed = stored(classed.select("e", "f", F.coalesce("root", "e").alias("root")), folder, "classes")
    kept = classed.groupBy("root").agg(F.min("f").alias("keep"))
    late = found.select("doc", "th", "line", "start", "stop", "n_words", "e").join(classed.select("e", "root").join(kept, "root"), "e")
    late = late.filter(F.struct("doc", "th", "start") != F.col("keep"))
    late = late.groupBy("doc", "th", "start", "stop", "n_words", "keep").agg(F.max("line").alias("line"))
    kind = df.schema[ident].dataType.simpleString()
    back = lambda c: F.when(F.col(c) == F.lit((1 << 63) - 1), None).otherwise(F.col(c)).cast(kind)
    return late.select(
        back("doc").alias("doc_id"), "start", "stop", "n_words", F.when(F.col("line"), "line").otherwise("sentence").alias("unit"),
        back("keep.doc").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"),
    )
