"""Language-model scoring with sharded Elias-Fano tries.

The model is a bigram with a Dirichlet prior on the unigram:
P(w | v) = (c(v, w) + M * P(w)) / (c(v) + M). Its logarithm falls into a part that depends on
(v, w) and one that depends on v alone, and v is itself a predicted token of the text. So
all that is known about a word meets in one shard, and a shard's trie answers every
question about its words: no task needs the whole model, whose size grows with the corpus.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import checkpoint_dir, fold_of, partitions_for, prepare, stored
from pourstat.llm.eliasfano import EliasFano

END, BEGIN = 0, 1
#: Weight of the unigram prior in tokens.
PRIOR = 500.0
#: A word with more than this share of the training tokens is hot; there are at most 1 / HOT.
HOT = 1 / 2000
#: Tokens of a chunk of texts, and tokens of a shard.
CHUNK = 2_000_000
SHARD = 1_500_000
#: Words a Python worker remembers.
CACHE = 250_000
LEVELS = 1 << 16
#: Frequent tokens that travel as two-byte codes instead of eight-byte hashes.
COMMON = 1 << 16


class Totals(NamedTuple):
    tokens: int  # N, training tokens with ends
    types: int  # V, distinct training tokens with the end
    texts: int  # training texts
    hot: dict[int, int]  # counts of hot tokens
    common: np.ndarray  # sorted numbers of the most frequent tokens


class Words:
    """Token numbers: 64-bit hashes of words, remembered while there is room."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words, and the end."""
        words = (text or "").encode().lower().split()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = np.empty(len(words) + 1, np.uint64)
        for i, w in enumerate(words):
            k = known.get(w)
            if k is None:
                k = known[w] = max(2, xxhash.xxh3_64_intdigest(w))
            out[i] = k
        out[-1] = END
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training token counts of each batch."""
    words = Words()
    for batch in batches:
        ids = [words.of(t) for t in batch.column(0).to_pylist()]
        token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *ids]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])


def learn_totals(rows: DataFrame, folder: str) -> Totals:
    """Unigram totals over all training rows (``train`` true); at most 1 / HOT counts and ``COMMON`` tokens reach the driver."""
    counts = stored(
        rows.filter("train").select("text").mapInArrow(_counts, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")),
        folder, "unigrams",
    )
    sums = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.sum(F.when(F.col("token") == END, F.col("n"))).alias("texts")).first()
    tokens = sums["tokens"] or 0
    hot = counts.filter(F.col("n") > max(tokens * HOT, 1)).collect()
    common = counts.orderBy(F.desc("n"), "token").select("token").limit(COMMON).toArrow()["token"].to_numpy().view(np.uint64)
    return Totals(tokens, sums["types"], sums["texts"] or 0, {r["token"] % (1 << 64): r["n"] for r in hot}, np.sort(common))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shard_of(token: np.ndarray, context: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """A token's shard; a hot token is spread over all shards by its context."""
    key = np.where(np.isin(token, hot), _mix(token ^ _mix(context)), _mix(token))
    return (_mix(key) % np.uint64(shards)).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted whole numbers as narrow differences; ``np.cumsum`` restores them."""
    return _narrow(np.diff(x.astype(np.int64), prepend=0))


def _slim(tokens: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct tokens as steps between places among the common ones, and the others."""
    at = np.searchsorted(common, tokens)
    there = at < len(common)
    there[there] = common[at[there]] == tokens[there]
    return [_steps(at[there]), tokens[~there]]


def _whole(steps: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The tokens that ``_slim`` packed."""
    return np.sort(np.concatenate([common[np.cumsum(steps, dtype=np.int64)], others]))


def pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *[v for a in arrays for v in (a.dtype.num, len(a))]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *[a.tobytes() for a in arrays]]))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    kinds = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int64, np.float32, np.float64)}
    at, out = 8 + 16 * n, []
    for num, size in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(data, kinds[num], size, at))
        at += size * kinds[num].itemsize
    return out


_DEALT = "shard bigint, chunk bigint, ids array<bigint>, blob binary"


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _parcels(chunk: int, ids: list[int | None], train: list[bool], texts: list[np.ndarray], hot: np.ndarray, shards: int, common: np.ndarray) -> pa.RecordBatch:
    """A packed row per shard: the tokens of a chunk of texts with context and text, sorted by token.

    One more row carries the ids of the chunk's texts past the shards.
    """
    size = np.array([len(t) for t in texts], np.int64)
    token = np.concatenate(texts)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.cumsum(size) - size] = BEGIN
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), size)
    shard = shard_of(token, context, hot, shards).astype(np.uint32)
    order = np.lexsort((token, shard))
    token, context, owner, shard = token[order], context[order], owner[order], shard[order]
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    fit = np.array(train, np.uint8)
    rows: list[tuple] = [(chunk % shards, chunk, ids, None)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a == b:
            continue
        here, local = np.unique(owner[a:b], return_inverse=True)
        names, count = np.unique(token[a:b], return_counts=True)
        contexts, code = np.unique(context[a:b], return_inverse=True)
        parts = [_steps(here), fit[here], *_slim(names, common), _narrow(count), *_slim(contexts, common), _narrow(code), _narrow(local)]
        rows.append((k, chunk, None, pack(parts)))
    return _rows(["shard", "chunk", "ids", "blob"], [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()], rows)


class Trie:
    """Two levels over tokens and the contexts before them, mapped from a file.

    Level one holds the tokens of a shard, level two the contexts of each token, numbered
    within the shard and shifted by the token's place so that the whole level is monotone;
    pointers cut it into the ranges of the tokens. Probabilities are quantised.
    """

    def __init__(self, names: np.ndarray, contexts: np.ndarray, place: np.ndarray, count: np.ndarray, token_count: np.ndarray, total: Totals):
        """Sorted distinct tokens with their whole training counts, sorted distinct contexts, and the
        counts of pairs at ``place`` = token * (number of contexts) + context, in order."""
        self.size = len(contexts)
        node = (place // np.uint64(self.size)).astype(np.int64)
        unigram = (token_count + 0.5) / (total.tokens + 0.5 * (total.types + 1))
        parts = {
            "names": EliasFano(names), "contexts": EliasFano(contexts), "pairs": EliasFano(place),
            "pointers": EliasFano(np.searchsorted(node, np.arange(len(names) + 1))),
        }
        arrays = {f"{k}.{q}": a for k, e in parts.items() for q, a in e.parts().items()}
        arrays |= self._quantised("joint", np.log10(count + PRIOR * unigram[node]))
        arrays |= self._quantised("alone", np.log10(PRIOR * unigram))
        arrays |= self._quantised("as_context", np.log10(token_count + PRIOR))
        handle, self.path = tempfile.mkstemp(prefix="trie-")
        offsets, at = {}, 0
        with os.fdopen(handle, "wb") as f:
            for k, a in arrays.items():
                offsets[k] = (at, a.dtype, len(a))
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
                at += a.nbytes + (-a.nbytes % 8)
        mapped = np.memmap(self.path, np.uint8, "r") if at else np.zeros(0, np.uint8)
        self.a = {k: mapped[o : o + d.itemsize * n].view(d) for k, (o, d, n) in offsets.items()}
        self.level = {k: EliasFano(parts={q: self.a[f"{k}.{q}"] for q in ("head", "low", "high", "ones")}) for k in parts}

    @staticmethod
    def _quantised(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
        step = (hi - lo) / (LEVELS - 1) or 1.0
        return {f"{name}.scale": np.array([lo, step]), f"{name}.code": np.round((x - lo) / step).astype(np.uint16)}

    def _value(self, name: str, i: np.ndarray) -> np.ndarray:
        lo, step = self.a[f"{name}.scale"]
        return lo + step * self.a[f"{name}.code"][i]

    def numerators(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10(c(v, w) + M P(w)) of tokens in the first level."""
        node, _ = self.level["names"].successor(token)
        out = self._value("alone", node)
        code, known = self.level["contexts"].successor(context)
        k = np.flatnonzero(known)
        at, there = self.level["pairs"].successor(node[k].astype(np.uint64) * np.uint64(self.size) + code[k].astype(np.uint64))
        # A successor counts only inside the token's own range.
        lo, hi = self.level["pointers"].get(node[k]), self.level["pointers"].get(node[k] + 1)
        good = there & (at >= lo.astype(np.int64)) & (at < hi.astype(np.int64))
        out[k[good]] = self._value("joint", at[good])
        return out

    def denominators(self, token: np.ndarray) -> np.ndarray:
        """log10(c(w) + M), for a token as the next one's context."""
        return self._value("as_context", self.level["names"].successor(token)[0])

    def close(self) -> None:
        os.remove(self.path)


def _opened(blob: bytes, common: np.ndarray) -> list[np.ndarray]:
    """Texts, their role, tokens, counts, contexts, and per occurrence the places of context and text."""
    here, fit, name_steps, names, count, context_steps, contexts, code, local = unpack(blob)
    return [np.cumsum(here, dtype=np.int64), fit, _whole(name_steps, names, common), count, _whole(context_steps, contexts, common), code, local]


def score_shard(blobs: list[bytes], total: Totals) -> list[bytes]:
    """For each packed row of a shard its texts' partial sums: text, tokens, known tokens, base and model score."""
    parcels = [_opened(b, total.common) for b in blobs]
    names = np.unique(np.concatenate([p[2] for p in parcels]))
    contexts = np.unique(np.concatenate([p[4] for p in parcels]))
    # Pairs are numbered by token and context within the shard; only these numbers are sorted.
    place = np.concatenate(
        [np.repeat(np.searchsorted(names, p[2]), p[3]).astype(np.uint64) * np.uint64(len(contexts)) + np.searchsorted(contexts, p[4])[p[5]].astype(np.uint64) for p in parcels]
    )
    fit = np.concatenate([p[1][p[6]] for p in parcels])
    pairs, pair = np.unique(place, return_inverse=True)
    del place
    counts = np.bincount(pair[fit == 1], minlength=len(pairs))
    node = (pairs // np.uint64(len(contexts))).astype(np.int64)
    token_count = np.bincount(node, weights=counts, minlength=len(names)).astype(np.int64)
    for k, n in total.hot.items():
        i = int(np.searchsorted(names, np.uint64(k)))
        if i < len(names) and int(names[i]) == k:
            token_count[i] = n
    seen = counts > 0
    trie = Trie(names, contexts, pairs[seen], counts[seen], token_count, total)
    context = contexts[(pairs % np.uint64(len(contexts))).astype(np.int64)]
    value = trie.numerators(names[node], context) - np.where(names == END, 0.0, trie.denominators(names))[node]
    trie.close()
    # The first token of a text has the begin of text as its context.
    value[context == BEGIN] -= np.log10(total.texts + PRIOR)
    base = np.log10((token_count + 0.5) / (total.tokens + 0.5 * (total.types + 1)))
    known = token_count > 0
    out, at = [], 0
    for p in parcels:
        here, local = p[0], p[6]
        mine = pair[at : at + len(local)]
        at += len(local)
        n = len(here)
        # Most texts have one token of a small shard, so few base scores differ.
        bases, base_code = np.unique(np.bincount(local, weights=base[node[mine]], minlength=n), return_inverse=True)
        out.append(
            pack([
                _steps(here), _narrow(np.bincount(local, minlength=n)), _narrow(np.bincount(local, weights=known[node[mine]], minlength=n)),
                bases, _narrow(base_code), np.bincount(local, weights=value[mine], minlength=n).astype(np.float32),
            ])
        )
    return out


_ANSWERED = "chunk bigint, ids array<bigint>, blob binary"
_SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial sums of each chunk; rows come sorted by chunk."""

    def whole(ids: list, blobs: list[bytes]) -> pa.RecordBatch:
        sums = [np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))]
        for blob in blobs:
            steps, n, known, bases, base_code, value = unpack(blob)
            here = np.cumsum(steps, dtype=np.int64)
            for total, part in zip(sums, (n, known, bases[base_code], value)):
                total[here] += part.astype(total.dtype)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]
        )

    chunk, ids, blobs = None, None, []
    for batch in batches:
        for k, these, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if k != chunk and chunk is not None:
                yield whole(ids, blobs)
                blobs = []
            chunk = k
            if these.is_valid:
                ids = these.as_py()
            else:
                blobs.append(blob.as_py())
    if chunk is not None:
        yield whole(ids, blobs)


def score_texts(df: DataFrame, train, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``train`` is a condition on the id that picks the training rows (NULL counts as true).
    NULL texts are empty; an empty text has its end as only token. Repeated rows count as
    often as they occur and get equal scores; an empty table gives an empty result. Words
    are told apart by 64-bit hashes. Counts cover the whole corpus; what meets in a task is
    bounded by ``CHUNK`` and ``SHARD``, and hot words are spread over all shards.
    """
    spark = df.sparkSession
    prepare(spark)
    folder = f"{checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    rows = df.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("train", F.coalesce(train(F.col("doc_id")), F.lit(True)))
    total = learn_totals(rows, folder)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = partitions_for(total.tokens, 2 * SHARD, least)
    shards = 2 * parts
    hot = np.array(sorted(total.hot), np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk = Words(), TaskContext.get().partitionId() << 32
        ids, fit, texts, size = [], [], [], 0
        for batch in batches:
            for doc, f, t in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(doc)
                fit.append(f)
                texts.append(words.of(t))
                size += len(texts[-1])
                if size >= CHUNK:
                    yield _parcels(chunk, ids, fit, texts, hot, shards, total.common)
                    chunk += 1
                    ids, fit, texts, size = [], [], [], 0
        if ids:
            yield _parcels(chunk, ids, fit, texts, hot, shards, total.common)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["chunk", "ids", "blob"], [pa.int64(), pa.list_(pa.int64()), pa.binary()]
        shard, chunks, blobs = None, [], []
        for batch in batches:
            for k, chunk, ids, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if k != shard and blobs:
                    yield _rows(names, kinds, [(c, None, b) for c, b in zip(chunks, score_shard(blobs, total))])
                    chunks, blobs = [], []
                shard = k
                if ids.is_valid:
                    yield _rows(names, kinds, [(chunk, ids.as_py(), None)])
                else:
                    chunks.append(chunk)
                    blobs.append(blob.as_py())
        if blobs:
            yield _rows(names, kinds, [(c, None, b) for c, b in zip(chunks, score_shard(blobs, total))])

    dealt = rows.select("doc_id", "train", "text").mapInArrow(deal, _DEALT)
    answered = dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(answer, _ANSWERED)
    scored = answered.repartition(least, "chunk").sortWithinPartitions("chunk").mapInArrow(gather, _SCORED)
    kind = df.schema[ident].dataType.simpleString()
    return scored.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", "n_known", F.lit(total.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def scores_of_documents(docs: DataFrame) -> DataFrame:
    """Learn from four of five folds of the ids (a NULL id trains), score all."""
    out = score_texts(docs, lambda doc_id: fold_of(doc_id) != 1)
    held = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
