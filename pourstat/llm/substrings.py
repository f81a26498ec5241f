"""Exact removal of long repeated byte strings with suffix arrays.

Every string of ``LENGTH`` bytes holds an anchor, the ``GRAM`` bytes with the smallest hash
in it, so equal strings hold the same anchor at the same place and meet by the anchor's
hash. Anchors whose whole surroundings are equal are settled by that. Where one anchor has
different surroundings, these are cut into short spans that are sorted as suffixes: only
suffixes smaller than their successors are sorted directly, bucket scans induce the rest,
and adjacent common prefixes give the classes of equal strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import checkpoint_dir, identified, partitions_for, prepare, stored

LENGTH = 100
GRAM = 32
#: Starts that one anchor can serve.
REACH = LENGTH - GRAM + 1
#: Bytes scanned at once.
SLICE = 1 << 18
#: Starts of one span; its strings share LENGTH - SPAN + 1 bytes, which are its key.
SPAN = 18
#: Keys with up to this many spans are sorted; beyond, strings are compared one by one by digest.
GROUP = 6000
#: Spans sorted together in one suffix array, and spans of a partition.
SORTED_SPANS = 8000
PART_SPANS = 40_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Scanner:
    """Polynomial hashes modulo 2^64 of all substrings of a slice from one running sum."""

    def __init__(self, size: int):
        self.up = _powers(_ODD, size + 1)
        self.down = _powers(np.uint64(pow(int(_ODD), -1, 1 << 64)), size + 1)
        self.code = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.down[: len(data)], out=out[1:])
        return out

    def hash(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        x = (sums[hi] - sums[lo]) * self.up[lo]
        x ^= x >> np.uint64(29)
        x *= _MIX
        return x ^ (x >> np.uint64(32))

    def anchors(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Anchors of texts ``data[begin:end]`` for starts from ``low`` to before ``high``.

        Returns positions, first and last served start, gram hash and hash of the surroundings.
        """
        n = len(data)
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        sums = self.sums(data)
        at = np.arange(n - GRAM + 1)
        grams = (sums[GRAM:] - sums[: n - GRAM + 1]) * self.up[: n - GRAM + 1]
        grams ^= grams >> np.uint64(29)
        grams *= _MIX
        grams ^= grams >> np.uint64(32)
        key = (grams & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
        least, width = key, 1
        while 2 * width <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH - width
        if rest:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)  # by start
        # Starts that are asked for and whose string ends inside their text.
        hi = np.minimum(high, end - LENGTH + 1)
        lo = np.minimum(low, hi)
        delta = np.zeros(len(place) + 1, np.int64)
        np.add.at(delta, lo, 1)
        np.add.at(delta, np.maximum(hi, lo), -1)
        starts = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        p = place[starts]
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        first, last, p = starts[new], starts[np.append(new[1:], len(starts)) - 1], p[new]
        text = np.searchsorted(end, p, side="right")
        left = np.maximum(p - REACH + 1, begin[text])
        right = np.minimum(p + LENGTH, end[text])
        around = self.hash(sums, left, right) ^ (((p - left) * 256 + (right - p)).astype(np.uint64) * _ODD)
        return p, first, last, grams[p], around


def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Groups of (text, from, to, first start, end of starts) of about SLICE bytes; long texts are cut with margins."""
    group, size = [], 0
    for k, t in enumerate(texts):
        n = len(t)
        if n < LENGTH:
            continue
        for s in range(0, n - LENGTH + 1, SLICE):
            e = min(s + SLICE, n - LENGTH + 1)
            a, b = max(0, s - LENGTH), min(n, e + 2 * LENGTH)
            group.append((k, a, b, s, e))
            size += b - a
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(2 * SLICE + 4 * LENGTH)
    for batch in batches:
        doc, th, text = batch.columns
        doc, th = doc.to_numpy(), th.to_numpy()
        texts = [t.encode() if t else b"" for t in text.to_pylist()]
        for group in _slices(texts):
            data = np.frombuffer(b"".join(texts[k][a:b] for k, a, b, _, _ in group), np.uint8)
            k, a, b, s, e = (np.array(x, np.int64) for x in zip(*group))
            end = np.cumsum(b - a)
            begin = end - (b - a)
            shift = begin - a
            p, first, last, gram, around = scanner.anchors(data, begin, end, s + shift, e + shift)
            if not len(p):
                continue
            owner = np.searchsorted(end, p, side="right")
            pos = ((p - shift[owner]) << 14) | ((p - first) << 7) | (p - last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc[k[owner]]), pa.array(th[k[owner]]), pa.array(pos)],
                names=["h", "w", "doc", "th", "pos"],
            )


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of numbers below 258 whose zeros end strings.

    Zeros count as different, in the order of their places. Suffixes smaller than their
    successors (type B) are sorted directly by packed words up to their string's end; scans
    over the buckets in order place every other suffix (type A) behind the sorted one that
    follows it.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # Type by the next differing number: runs of equal numbers share the type of their last.
    change = np.append(text[:-1] != text[1:], True)
    run_end = np.flatnonzero(change)
    nxt = np.append(text, 0)[run_end + 1].astype(np.int64)
    small = text[run_end].astype(np.int64) < nxt
    small[-1] = False
    is_b = np.repeat(small, np.diff(np.append(-1, run_end))) & (text > 0)
    zeros = np.flatnonzero(text == 0)
    b = np.flatnonzero(is_b)
    order = b
    if len(b):
        stop = np.append(zeros, n)[np.searchsorted(zeros, b)]
        depth = int((stop - b).max()) + 1
        # Four 16-bit numbers make a word; past the end of a string there are zeros.
        padded = np.concatenate([text.astype(np.uint16), np.zeros(depth + 8, np.uint16)])
        words = []
        for d in range(0, depth, 4):
            word = np.zeros(len(b), np.uint64)
            for q in range(4):
                x = padded[b + d + q].astype(np.uint64)
                x[b + d + q > stop] = 0
                word = (word << np.uint64(16)) | x
            words.append(word)
        order = b[np.lexsort(words[::-1])]
    head = np.bincount(text, minlength=259)
    head = np.cumsum(head) - head
    sa = np.full(n, -1, np.int64)
    fill = head.copy()  # next free place of each bucket's A part
    sa[: len(zeros)] = zeros
    by_char = np.searchsorted(text[order], np.arange(260), side="left") if len(order) else np.zeros(260, np.int64)
    for c in range(258):
        if c == 0:
            done = zeros
        else:
            lo, at = int(head[c]), int(head[c])
            # The A part grows while it is scanned: predecessors with the same number join it.
            while at < fill[c]:
                block = sa[at : fill[c]]
                at = int(fill[c])
                before = block[block > 0] - 1
                before = before[text[before] == c]
                sa[at : at + len(before)] = before
                fill[c] += len(before)
            mine = order[by_char[c] : by_char[c + 1]]
            sa[int(fill[c]) : int(fill[c]) + len(mine)] = mine
            done = sa[lo : int(fill[c]) + len(mine)]
        before = done[done > 0] - 1
        before = before[text[before] > c]
        if len(before):
            ch = text[before]
            grouped = np.argsort(ch, kind="stable")
            before, ch = before[grouped], ch[grouped]
            size = np.bincount(ch, minlength=259)
            offset = np.arange(len(before)) - np.repeat(np.cumsum(size) - size, size)
            sa[fill[ch] + offset] = before
            fill += size
    return sa


def repeated_starts(spans: list[bytes], rank: np.ndarray) -> list[tuple[int, int]]:
    """(span, offset) of every LENGTH-byte string that an earlier one equals.

    ``rank`` orders the spans by document and place; within a span smaller offsets come first.
    """
    size = np.array([len(x) for x in spans], np.int64)
    text = np.zeros(int(size.sum()) + len(spans), np.int64)
    base = np.cumsum(size + 1) - size - 1
    inner = np.ones(len(text), bool)
    inner[base + size] = False
    text[inner] = np.frombuffer(b"".join(spans), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(spans)), size + 1)
    offset = np.arange(len(text)) - base[owner]
    sa = suffix_order(text)
    sa = sa[offset[sa] + LENGTH <= size[owner[sa]]]
    if not len(sa):
        return []
    same = np.zeros(len(sa), bool)
    window = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), LENGTH)
    for lo in range(1, len(sa), 1 << 15):
        hi = min(len(sa), lo + (1 << 15))
        prefix = np.cumprod(window[sa[lo:hi]] == window[sa[lo - 1 : hi - 1]], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        same[lo:hi] = prefix >= LENGTH
    group = np.cumsum(~same)
    by = np.lexsort((offset[sa], rank[owner[sa]], group))
    later = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    late = sa[by[later]]
    return list(zip(owner[late].tolist(), offset[late].tolist()))


def _ranges(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(doc, th, start, stop) of runs of neighbouring repeated starts."""
    out: list[list[int]] = []
    for doc, th, s in sorted(rows):
        if out and out[-1][0] == doc and out[-1][1] == th and s <= out[-1][3] - LENGTH + 1:
            out[-1][3] = s + LENGTH
        else:
            out.append([doc, th, s, s + LENGTH])
    return [tuple(x) for x in out]


_CUT = "doc bigint, th bigint, start bigint, stop bigint"


def _cut_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc", "th", "start", "stop"])


def _sort_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are sorted together, about SORTED_SPANS at a time."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        order = sorted(range(len(rows)), key=lambda k: rows[k][1:4])
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        late = repeated_starts([r[4] for r in rows], rank)
        return _cut_batch(_ranges([(rows[k][1], rows[k][2], rows[k][3] + o) for k, o in late]))

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= SORTED_SPANS and row[0] != held[-1][0]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the surroundings of a document's chosen anchors."""
    for batch in batches:
        keys, docs, ths, starts, data = [], [], [], [], []
        for doc, th, text, places in zip(*(c.to_pylist() for c in batch.columns)):
            t = text.encode()
            for pos in places:
                p, first, last = pos >> 14, (pos >> 14) - (pos >> 7 & 127), (pos >> 14) - (pos & 127)
                # Spans lie at fixed places about the anchor, so equal strings share their span's key.
                for q in range(p - REACH + 1, p + 1, SPAN):
                    top = min(q + SPAN - 1, p)
                    lo, hi = max(q, first), min(top, last)
                    if lo > hi:
                        continue
                    keys.append(xxhash.xxh3_64_intdigest(t[top : q + LENGTH], q - p + 1000) - (1 << 63))
                    docs.append(doc)
                    ths.append(th)
                    starts.append(lo)
                    data.append(t[lo : hi + LENGTH])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())],
            names=["key", "doc", "th", "start", "span"],
        )


def _single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every LENGTH-byte string of a span, by a 128-bit digest."""
    for batch in batches:
        out: list[tuple[int, int, int, int, int]] = []
        for _, doc, th, start, span in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(len(span) - LENGTH + 1):
                d = xxhash.xxh3_128_intdigest(span[k : k + LENGTH])
                out.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), doc, th, start + k))
        columns = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["d1", "d2", "doc", "th", "start"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        kept: list[bytes] = []
        for text, cuts in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            t = (text or "").encode()
            left, at, removed, spans, reach = [], 0, 0, 0, -1
            for c in sorted((c["start"], c["stop"]) for c in cuts or []):
                if c[0] > reach:
                    spans += 1
                    left.append(t[at : c[0]])
                    removed += c[1] - c[0]
                    at = reach = c[1]
                elif c[1] > reach:
                    removed += c[1] - reach
                    at = reach = c[1]
            left.append(t[at:])
            kept.append(b"".join(left))
            out.append((len(t), removed, spans))
        n, removed, spans = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            names=[*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept"],
        )


def repeated_cuts(rows: DataFrame, folder: str) -> DataFrame:
    """``doc, th, start, stop``: byte ranges covered by strings that start earlier elsewhere."""
    anchors = rows.select("doc", "th", "text").mapInArrow(_anchor_rows, "h bigint, w bigint, doc bigint, th bigint, pos bigint")
    common = anchors.groupBy("h").agg(F.count("*").alias("n"), (F.min("w") != F.max("w")).alias("mixed")).filter("n > 1").drop("n")
    met = stored(anchors.join(common, "h"), folder, "anchors")
    place = F.struct("doc", "th", F.shiftright("pos", 14).alias("p"))
    first = met.groupBy("h", "w").agg(F.min(place).alias("f"))
    ranked = stored(met.join(first, ["h", "w"]).select("doc", "th", "pos", "mixed", (place == F.col("f")).alias("is_first")), folder, "ranked")
    p = F.shiftright("pos", 14)
    settled = ranked.filter("NOT is_first").select(
        "doc", "th", (p - F.shiftright("pos", 7).bitwiseAND(127)).alias("start"), (p - F.col("pos").bitwiseAND(127) + LENGTH).alias("stop")
    )
    open_ = ranked.filter("is_first AND mixed").groupBy("doc", "th").agg(F.collect_list("pos").alias("places"))
    spans = stored(
        rows.select("doc", "th", "text").join(open_, ["doc", "th"]).mapInArrow(_spans, "key bigint, doc bigint, th bigint, start bigint, span binary"),
        folder, "spans",
    )
    met_again = spans.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = stored(spans.join(met_again, "key"), folder, "grouped")
    few = grouped.filter(F.col("n") <= GROUP).drop("n")
    parts = partitions_for(few.count(), PART_SPANS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_cuts = few.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sort_spans, _CUT)
    # Keys with very many spans: equal strings are folded map-side, so no group gathers anywhere.
    single = grouped.filter(F.col("n") > GROUP).drop("n").mapInArrow(_single_strings, "d1 bigint, d2 bigint, doc bigint, th bigint, start bigint")
    one = F.struct("doc", "th", "start")
    least = single.groupBy("d1", "d2").agg(F.min(one).alias("f"))
    late = single.join(least, ["d1", "d2"]).filter(one != F.col("f")).select("doc", "th", "start", (F.col("start") + LENGTH).alias("stop"))
    return settled.unionByName(sorted_cuts).unionByName(late)


def remove_repeats(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) for every row.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
    smaller id, or before it in the same text. Strings are judged on the input. NULL texts
    count as empty, NULL ids come last. Rows that repeat an id are ordered by a hash of
    their texts; rows equal in both are one document and get equal results. Matches
    never cross rows. An empty table gives an empty result.
    """
    prepare(df.sparkSession)
    folder = f"{checkpoint_dir(df.sparkSession)}/repeats-{uuid.uuid4().hex}"
    rows = identified(df, ident, text)
    cuts = repeated_cuts(rows, folder).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    joined = rows.join(cuts, ["doc", "th"], "left").select("doc_id", "text", "cuts")
    kind = df.schema[ident].dataType.simpleString()
    return joined.mapInArrow(_apply, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
