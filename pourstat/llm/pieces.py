"""Unigram encoding and decoding with the pieces of a SentencePiece model.

A text is escaped (a leading space, spaces as U+2581) and cut into the sequence of pieces
with the largest sum of log scores. Candidate pieces come from a double-array trie over
UTF-8 bytes; a character that no piece covers alone is written as its byte pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import prepare

MARK = "▁"
#: An uncovered character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: A piece table is broadcast; larger files are refused.
MAX_MODEL_BYTES = 64 << 20
#: Chunks up to this many bytes go through the vectorised search.
SHORT = 40
#: Distinct chunks remembered by a Python worker.
CACHE = 300_000


class Pieces(NamedTuple):
    base: np.ndarray  # double array: child of s by byte b is base[s] + b + 1
    check: np.ndarray  # ... if check[child] == s
    piece: np.ndarray  # piece id at a node, or -1
    score: np.ndarray  # log score by piece id
    byte_ids: np.ndarray  # piece id of each byte, or the unknown id
    surface: list[bytes]  # decoded bytes by piece id
    unknown_score: float
    splits: bool  # no piece has a mark behind another character, nor a line end


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays of a trie over byte strings."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, ident in keys:
        node = 0
        for b in key:
            nxt = children[node].get(b)
            if nxt is None:
                nxt = children[node][b] = len(children)
                children.append({})
                value.append(-1)
            node = nxt
        value[node] = ident
    size = 3 * len(children) + 4096
    used = np.zeros(size, bool)
    used[:258] = True  # the root; no child is placed below the largest code
    base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    out[0] = value[0]
    first = 258  # no free cell lies before it
    todo = [(0, 0)]
    while todo:
        node, at = todo.pop()
        if not children[node]:
            continue
        codes = np.fromiter(sorted(children[node]), np.int64) + 1
        if first + 4096 >= len(used):
            grow = len(used)
            used = np.concatenate([used, np.zeros(grow, bool)])
            base = np.concatenate([base, np.zeros(grow, np.int32)])
            check = np.concatenate([check, np.full(grow, -1, np.int32)])
            out = np.concatenate([out, np.full(grow, -1, np.int32)])
        first += int(np.argmin(used[first:]))
        # Free cells for the first child, tried together; the last one is always free.
        start = -1
        for width in (64, 1024, len(used)):
            cells = first + np.flatnonzero(~used[first : first + width])
            cells = cells[cells < len(used) - 512] - codes[0]
            fits = ~used[cells[:, None] + codes].any(axis=1)
            if fits.any():
                start = int(cells[np.argmax(fits)])
                break
        base[at] = start
        for c in codes.tolist():
            used[start + c], check[start + c] = True, at
            child = children[node][c - 1]
            out[start + c] = value[child]
            todo.append((child, start + c))
    end = int(np.flatnonzero(used)[-1]) + 258
    return tuple(np.concatenate([a, np.full(max(0, end - len(a)), f, np.int32)])[:end] for a, f in ((base, 0), (check, -1), (out, -1)))


def load(path: str) -> Pieces:
    """Read the pieces and scores of a model file."""
    import sentencepiece

    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is over {MAX_MODEL_BYTES} bytes")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    score = np.array([sp.get_score(i) for i in range(n)], np.float64)
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids = np.full(256, sp.unk_id(), np.int32)
    surface = [x.replace(MARK, " ").encode() for x in names]
    for i in range(n):
        if sp.is_byte(i):
            b = int(names[i][3:5], 16)
            byte_ids[b], surface[i] = i, bytes([b])
        elif sp.is_control(i):
            surface[i] = b""
    splits = not any(MARK in names[i].lstrip(MARK) or "\n" in names[i] for i in normal)
    base, check, piece = double_array([(names[i].encode(), i) for i in normal])
    return Pieces(base, check, piece, score, byte_ids, surface, float(score[normal].min()) - UNKNOWN_PENALTY, splits)


def _char_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def viterbi(p: Pieces, data: bytes) -> list[int]:
    """Best pieces of one chunk. Of equal sums the one with the earlier start of its last piece wins."""
    n, base, check, piece, score = len(data), p.base, p.check, p.piece, p.score
    best, came, by = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    i = 0
    while i < n:
        step, node, alone = _char_length(data[i]), 0, False
        for j in range(i, n):
            child = int(base[node]) + data[j] + 1
            if check[child] != node:
                break
            node = child
            k = int(piece[node])
            if k >= 0:
                alone |= j + 1 - i == step
                s = best[i] + score[k]
                if s > best[j + 1]:
                    best[j + 1], came[j + 1], by[j + 1] = s, i, k
        if not alone and best[i] + p.unknown_score > best[min(n, i + step)]:
            e = min(n, i + step)
            best[e], came[e], by[e] = best[i] + p.unknown_score, i, -1
        i += step
    out: list[int] = []
    e = n
    while e > 0:
        out.extend([by[e]] if by[e] >= 0 else [int(p.byte_ids[b]) for b in data[came[e] : e][::-1]])
        e = came[e]
    return out[::-1]


def viterbi_many(p: Pieces, chunks: list[bytes]) -> list[np.ndarray]:
    """Best pieces of many short chunks; each step of the search runs over all of them."""
    order = sorted(range(len(chunks)), key=lambda x: len(chunks[x]))
    out: list[np.ndarray] = [None] * len(chunks)
    for lo in range(0, len(order), 8192):
        part = order[lo : lo + 8192]
        lens = np.array([len(chunks[x]) for x in part])
        width = int(lens[-1])
        text = np.frombuffer(b"".join(chunks[x].ljust(width, b"\0") for x in part), np.uint8).reshape(len(part), width)
        best = np.full((len(part), width + 1), -np.inf)
        came = np.zeros((len(part), width + 1), np.int32)
        by = np.full((len(part), width + 1), -1, np.int32)
        best[:, 0] = 0.0
        for i in range(width):
            rows = np.flatnonzero((lens > i) & ((text[:, i] & 0xC0) != 0x80))
            if not len(rows):
                continue
            lead = text[rows, i]
            step = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            alone = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for j in range(i, width):
                on = lens[rows[live]] > j
                live, node = live[on], node[on]
                child = p.base[node] + text[rows[live], j].astype(np.int64) + 1
                on = p.check[child] == node
                live, node = live[on], child[on]
                if not len(live):
                    break
                k = p.piece[node]
                hit = np.flatnonzero(k >= 0)
                at = live[hit]
                alone[at] |= step[at] == j + 1 - i
                s = best[rows[at], i] + p.score[k[hit]]
                up = s > best[rows[at], j + 1]
                r = rows[at[up]]
                best[r, j + 1], came[r, j + 1], by[r, j + 1] = s[up], i, k[hit[up]]
            none = np.flatnonzero(~alone)
            if len(none):
                r, e = rows[none], i + step[none]
                s = best[r, i] + p.unknown_score
                up = s > best[r, e]
                best[r[up], e[up]], came[r[up], e[up]], by[r[up], e[up]] = s[up], i, -1
        # All chunks walk back together; slots hold the pieces from the end.
        at = lens.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while (rows := np.flatnonzero(at > 0)).size:
            e = at[rows]
            k, start = by[rows, e], came[rows, e]
            size = np.where(k >= 0, 1, e - start)
            for q in range(int(size.max())):
                on = size > q
                found.append((rows[on], np.where(k[on] >= 0, k[on], p.byte_ids[text[rows[on], e[on] - 1 - q]])))
            at[rows] = start
        row = np.concatenate([x for x, _ in found])[::-1]
        ids = np.concatenate([x for _, x in found])[::-1]
        grouped = np.argsort(row, kind="stable")
        for x, one in zip(part, np.split(ids[grouped], np.cumsum(np.bincount(row, minlength=len(part)))[:-1])):
            out[x] = one.astype(np.int32)
    return out


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run behind the other."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


class Codec:
    """Encodes and decodes batches; remembers the pieces of chunks seen before."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        # No piece crosses these cuts, so chunks can be searched apart.
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+") if pieces.splits else re.compile("(?s).+")
        self.bytes_of = np.frombuffer(b"".join(pieces.surface), np.uint8)
        self.len_of = np.array([len(x) for x in pieces.surface], np.int64)
        self.start_of = np.cumsum(self.len_of) - self.len_of
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        data = [x.encode() for x in fresh]
        got: list[np.ndarray] = [None] * len(data)
        short = [k for k, x in enumerate(data) if len(x) <= SHORT]
        for k, ids in zip(short, viterbi_many(self.p, [data[k] for k in short])):
            got[k] = ids
        for k, x in enumerate(data):
            if got[k] is None:
                got[k] = np.array(viterbi(self.p, x), np.int32)
        size = np.array([len(x) for x in got], np.int64)
        for x in fresh:
            self.code[x] = len(self.code)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *got])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All piece ids of the texts in a row, and the offsets of each text."""
        if len(self.code) > CACHE:
            self._clear()
        chunks = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = {c for doc in chunks for c in doc if c not in self.code}
        if fresh:
            self._learn(sorted(fresh))
        get = self.code.__getitem__
        codes = np.fromiter((get(c) for doc in chunks for c in doc), np.int64)
        size = self.size[codes]
        ends = np.cumsum([0, *map(len, chunks)])
        total = np.concatenate([[0], np.cumsum(size)])
        return self.flat[_ragged(self.begin[codes], size)], total[ends]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of runs of ids: bytes are joined, the leading space is taken off."""
        size = self.len_of[ids]
        data = self.bytes_of[_ragged(self.start_of[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of a broadcast table; a Python worker keeps it from task to task."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


class _Shared(NamedTuple):
    id: int
    handle: object

    @property
    def value(self):
        return self.handle.value


def encode_texts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ``pieces array<int>, n_pieces, n_byte_pieces, decoded, round_trip``.

    NULL and empty texts have no pieces; their decoded text is empty and counts as a round
    trip. ``decoded`` is made from the pieces alone. A text that itself contains U+2581 comes
    back with a space in its place, so ``round_trip`` is false. Rows are independent:
    repeated rows give repeated results. The piece table is broadcast; its file is at most
    ``MAX_MODEL_BYTES`` and does not depend on the data.
    """
    prepare(df.sparkSession)
    shared = _Shared(abs(hash((path, os.path.getmtime(path)))), df.sparkSession.sparkContext.broadcast(load(path)))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        is_byte = np.zeros(len(codec.p.surface), bool)
        is_byte[codec.p.byte_ids] = True
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids, at = codec.encode(texts)
            back = codec.decode(ids, at)
            byte_count = np.concatenate([[0], np.cumsum(is_byte[ids])])[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(np.diff(byte_count), pa.int64()),
                    pa.array(back, pa.string()),
                    pa.array([(t or "") == b for t, b in zip(texts, back)], pa.bool_()),
                ],
                names=[*names, "pieces", "n_pieces", "n_byte_pieces", "decoded", "round_trip"],
            )

    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(
        run, f"{kinds}, pieces array<int>, n_pieces bigint, n_byte_pieces bigint, decoded string, round_trip boolean"
    )
