"""Merkle manifest of a document table, in blocks that are laid out by van Emde Boas.

A document's leaf is the SHA-256 of its fields. The leaves of a source, by ascending doc_id,
are the lowest level of a tree in which 16 neighbours have one parent; the roots of the
sources, in order, are the leaves of one more tree. Digests are hashed as lowercase hex.

A tree is stored in aligned blocks of ``LEVELS`` hash levels. A block keeps its digests in one
array: the levels are split at half height, the upper half comes first, then the lower
subtrees one after the other, and every part is laid out the same way. ``address`` computes
the place of a node from its depth and number alone; building writes and looking up siblings
reads through it, and a path from a leaf to the root touches few stretches of the array
whatever the size of a cache line. The roots of the blocks are the leaves of the next tier of
blocks, so a source of any size takes a few tiers, and a task holds one block at a time.

Order and numbers come from a range partitioning by (source, doc_id, leaf, row number), so a
source with most of the rows is spread over tasks like any other, and so are repeated rows.

Rows: NULL fields are written as ``-``; NULL doc_ids come first in their source and NULL
sources first of all; rows with equal doc_id are ordered by leaf, equal leaves stay as separate
leaves; empty texts are values of zero bytes; texts of any length are hashed whole, inside the
JVM. An empty table has no leaves and yields no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pourstat.llm.common import checkpoint_dir, fold_of, lower_ascii, prepare, stored

#: Children of a node: four bits of a node number.
FANOUT, BITS = 16, 4

#: Hash levels of a block; three levels are 4096 leaves and 140 kB.
LEVELS = 3

DIGEST = 32


# --------------------------------------------------------------------------
# Layout
# --------------------------------------------------------------------------
def tree_size(height: int) -> int:
    """Nodes of a complete tree with ``height`` rows of nodes."""
    return (FANOUT**height - 1) // (FANOUT - 1)


def address(depth: int, number: np.ndarray, height: int) -> np.ndarray:
    """Places of nodes ``number`` at ``depth`` (the root has 0) in a tree of ``height`` rows."""
    if height == 1:
        return np.zeros_like(number)
    upper = height // 2
    if depth < upper:
        return address(depth, number, upper)
    below = depth - upper
    tree, inside = number >> (BITS * below), number & ((1 << (BITS * below)) - 1)
    return tree_size(upper) + tree * tree_size(height - upper) + address(below, inside, height - upper)


def parent_hash(digests: Iterable[bytes]) -> bytes:
    """SHA-256 of the concatenated hex digests."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def counts_of(leaves: int, height: int) -> list[int]:
    """Nodes that exist at each depth of a block of ``height`` rows, the root's first."""
    counts = [leaves]
    for _ in range(height - 1):
        counts.append(-(-counts[-1] // FANOUT))
    return counts[::-1]


def height_for(leaves: int) -> int:
    """Rows of nodes until one remains."""
    height = 1
    while leaves > 1:
        leaves, height = -(-leaves // FANOUT), height + 1
    return height


def build(leaves: list[bytes], height: int) -> bytes:
    """The array of a block: all nodes above ``leaves`` at their addresses.

    What lies behind the last existing node is cut off; gaps in front of it are zero.
    """
    counts = counts_of(len(leaves), height)
    last = max(int(address(d, np.array([n - 1]), height)[0]) for d, n in enumerate(counts))
    nodes = np.zeros((last + 1, DIGEST), np.uint8)
    row = leaves
    for depth in range(height - 1, -1, -1):
        nodes[address(depth, np.arange(len(row)), height)] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
        if depth:
            row = [parent_hash(row[i : i + FANOUT]) for i in range(0, len(row), FANOUT)]
    return nodes.tobytes()


def siblings(nodes: np.ndarray, height: int, depth: int, number: int, existing: int) -> tuple[int, list[str]]:
    """Place of a node in its run and the digests of the whole run, found by address."""
    first = number - number % FANOUT
    run = np.arange(first, min(first + FANOUT, existing))
    return number - first, [nodes[a].tobytes().hex() for a in address(depth, run, height)]


Path = list[tuple[int, str]]


def fold(digest: str, path: Path) -> str:
    """The root that a leaf and the siblings of its path give."""
    for place, others in path:
        cut = place * 2 * DIGEST
        digest = hashlib.sha256(f"{others[:cut]}{digest}{others[cut:]}".encode()).hexdigest()
    return digest


def leaf_paths(nodes: bytes, leaves: int, height: int, above: Path) -> Iterator[tuple[str, Path]]:
    """Every leaf of a block with its path; ``above`` leads from the block's root to the root of all."""
    array = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    counts = counts_of(leaves, height)
    paths = [(array[0].tobytes().hex(), above)]
    for depth in range(1, height):
        row: list[tuple[str, Path]] = []
        for first in range(0, counts[depth], FANOUT):
            _, run = siblings(array, height, depth, first, counts[depth])
            rest = paths[first // FANOUT][1]
            row += [(d, [(k, "".join(run[:k] + run[k + 1 :])), *rest]) for k, d in enumerate(run)]
        paths = row
    yield from paths


def pack_path(path: Path) -> str:
    return ";".join(f"{place}:{others}" for place, others in path)


def unpack_path(text: str) -> Path:
    return [(int(p), others) for p, others in (step.split(":") for step in text.split(";"))] if text else []


# --------------------------------------------------------------------------
# Leaves and their numbers
# --------------------------------------------------------------------------
def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Binary SHA-256 of the fields of a document."""
    return F.unhex(F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each lane inside one sorted partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    lane, seen = None, 0
    for batch in batches:
        lanes = batch.column("lane").dictionary_encode()
        codes = lanes.indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1]) if len(codes) else np.array([], int)
        number = np.arange(len(codes))
        for at, end in zip(starts, np.append(starts[1:], len(codes))):
            name = lanes.dictionary[int(codes[at])].as_py()
            if name != lane:
                lane, seen = name, 0
            number[at:end] += seen - at
            seen += end - at
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(codes), part), pa.int32()), pa.array(number, pa.int64())],
            [*batch.schema.names, "part", "within"],
        )


def numbered(rows: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """Adds ``rank`` (from 0) inside ``lane`` by ``order`` and ``total``, the rows of the lane.

    Rows are counted where the range partitioning has put them; the offsets of a lane come
    from one row per partition that it touches.
    """
    placed = rows.repartitionByRange("lane", *order).sortWithinPartitions("lane", *order)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in placed.schema)}, part int, within long"
    placed = stored(placed.mapInArrow(_numbers, schema), folder, name)
    sizes = placed.groupBy("lane", "part").agg(F.count("*").alias("n"))
    lane = Window.partitionBy("lane")
    offsets = sizes.select(
        "lane", "part", (F.sum("n").over(lane.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(lane).alias("total")
    )
    ranked = placed.join(offsets, ["lane", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    return ranked.drop("part", "within", "before")


# --------------------------------------------------------------------------
# Blocks
# --------------------------------------------------------------------------
BLOCK_ROW = pa.schema(
    [
        ("lane", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("height", pa.int32()), ("leaves", pa.int32()),
        ("nodes", pa.binary()), ("root", pa.binary()), ("ids", pa.list_(pa.int64())), ("changed", pa.list_(pa.binary())),
    ]
)
BLOCK_DDL = (
    "lane string, block long, total long, height int, leaves int, nodes binary, root binary, ids array<long>, changed array<binary>"
)


def _block_builder(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows to one row per block. A lane that fits one block stops at its single root."""

    def row(key, digests, ids, changed):
        lane, block, total = key
        height = levels + 1 if total > FANOUT**levels else height_for(total)
        nodes = build(digests, height)
        return [lane, block, total, height, len(digests), nodes, nodes[:DIGEST], ids, changed]

    def blocks(batches):
        key, digests, ids, changed = None, [], [], []
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("lane", "block", "total", "digest", "id", "change"))
            for lane, block, total, digest, ident, change in zip(*columns):
                if key != (lane, block, total):
                    if key is not None:
                        out.append(row(key, digests, ids, changed))
                    key, digests, ids, changed = (lane, block, total), [], [], []
                digests.append(digest)
                ids.append(ident)
                changed.append(change)
            if out:
                yield _batch(out, BLOCK_ROW)
        if key is not None:
            yield _batch([row(key, digests, ids, changed)], BLOCK_ROW)

    return blocks


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def forest(leaves: DataFrame, folder: str, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """Tiers of blocks over ``leaves`` (lane, rank, total, digest, id, change).

    Tier 0 holds the leaves; each further tier holds the block roots of lanes that are not
    finished. The number of tiers is the logarithm of the longest lane to the base of a block.
    """
    size, tiers = FANOUT**levels, []
    while True:
        rows = leaves.withColumn("block", F.floor(F.col("rank") / F.lit(size)).cast("long"))
        dealt = rows.repartition("lane", "block").sortWithinPartitions("lane", "block", "rank")
        tier = stored(dealt.mapInArrow(_block_builder(levels), BLOCK_DDL), folder, f"{name}-{len(tiers)}")
        tiers.append(tier)
        more = tier.filter(F.col("total") > size)
        if more.isEmpty():
            return tiers
        leaves = more.select(
            "lane", F.col("block").alias("rank"), F.ceil(F.col("total") / F.lit(size)).cast("long").alias("total"),
            F.col("root").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("change"),
        )


CHILD = pa.schema([("lane", pa.string()), ("block", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
CHILD_DDL = "lane string, block long, path string, subroot string, root string"


def _children(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The paths of a block's leaves, which are the blocks (or lanes) below it."""

    def paths(batches):
        for batch in batches:
            for b in batch.to_pylist():
                found = leaf_paths(b["nodes"], b["leaves"], b["height"], unpack_path(b["path"]))
                first = b["block"] * FANOUT**levels
                rows = [(b["lane"], first + k, pack_path(p), b["subroot"], b["top"]) for k, (_, p) in enumerate(found)]
                yield _batch(rows, CHILD)

    return paths


def with_paths(tiers: list[DataFrame], lanes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Tier 0 with ``path``, ``subroot`` and ``top`` (the root) of each block.

    ``lanes`` has the path, subroot and root of each lane. Paths go down tier by tier: a block
    that finishes its lane takes the lane's, any other one that of its leaf in the tier above.
    """
    down: DataFrame | None = None
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        ends = tier.filter(F.col("total") <= FANOUT**levels).join(lanes, "lane")
        joined = ends.select(*tier.columns, "path", "subroot", "top")
        if down is not None:
            inner = tier.filter(F.col("total") > FANOUT**levels).join(down.withColumnRenamed("root", "top"), ["lane", "block"])
            joined = joined.unionByName(inner.select(*tier.columns, "path", "subroot", "top"))
        if k:
            down = joined.mapInArrow(_children(levels), CHILD_DDL)
    return joined


# --------------------------------------------------------------------------
# Manifest
# --------------------------------------------------------------------------
def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The blocks of all sources with the way from each block to the root.

    One row per block: lane (``=`` and the source, or empty for NULL), block, total, height,
    leaves, nodes, root, ids, changed, path, subroot, top. ``changed`` has the leaf of the
    tampered document where a document is tampered with, else NULL.
    """
    prepare(docs.sparkSession)
    folder = f"{checkpoint_dir(docs.sparkSession)}/merkle-{uuid.uuid4().hex}"
    names = [F.col(f"`{c}`") for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = leaf_hash(*names[:4], lower_ascii(names[4]))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), names[1].cast("string")), F.lit("")).alias("lane"),
        names[0].cast("long").alias("id"),
        leaf_hash(*names).alias("digest"),
        F.when(fold_of(names[0]) == 0, tampered).alias("change"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Written before it is ordered: row numbers are fixed from here on, and texts are read once.
    leaves = stored(leaves, folder, "leaves")
    tiers = forest(numbered(leaves, ["id", "digest", "row"], folder, "numbered").drop("row"), folder, "blocks", levels)
    roots = None
    for tier in tiers:
        done = tier.filter(F.col("total") <= FANOUT**levels).select("lane", "root")
        roots = done if roots is None else roots.unionByName(done)
    named = roots.select(F.lit("").alias("lane"), F.col("lane").alias("name"), F.col("root").alias("digest"))
    ordered = stored(numbered(named, ["name"], folder, "sources"), folder, "lanes")
    upper = ordered.select("lane", "rank", "total", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("change"))
    top_tiers = forest(upper, folder, "tops", levels)
    only = top_tiers[-1].select("lane", F.lit("").alias("path"), F.lower(F.hex("root")).alias("subroot"), F.lower(F.hex("root")).alias("top"))
    ways = with_paths(top_tiers, only, levels).mapInArrow(_children(levels), CHILD_DDL)
    lanes = ordered.join(ways.select(F.col("block").alias("rank"), "path", F.col("root").alias("top")), "rank").select(
        F.col("name").alias("lane"), "path", F.lower(F.hex("digest")).alias("subroot"), "top"
    )
    return with_paths(tiers, stored(lanes, folder, "ways"), levels)


PROOF = pa.schema(
    [
        ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
        ("folded_root", pa.string()), ("verified", pa.bool_()),
    ]
)
PROOF_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            rows = []
            found = leaf_paths(b["nodes"], b["leaves"], b["height"], unpack_path(b["path"]))
            for (leaf, path), ident, change in zip(found, b["ids"], b["changed"]):
                proof = hashlib.sha256("".join([others for _, others in path]).encode()).hexdigest()
                folded = fold(leaf if change is None else change.hex(), path)
                rows.append((ident, leaf, b["subroot"], b["top"], proof, folded, folded == b["top"]))
            yield _batch(rows, PROOF)


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, roots, digest of the siblings and the verdict on the tampered copy of every document."""
    return manifest(docs, levels).mapInArrow(_verify, PROOF_DDL)


# --------------------------------------------------------------------------
# The same in SQL
# --------------------------------------------------------------------------
CRC32_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
    "lambda x, s: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)


def oracle(lane_levels: int = 6, source_levels: int = 4) -> str:
    """The same rows in DuckDB SQL for up to 16 to the power of ``lane_levels`` documents a source."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce('=' || source, '') AS lane, {leaf("text")} AS leaf,
  CASE WHEN {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(low)} END AS changed FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS i,
  coalesce(changed, leaf) AS f, '' AS proof FROM d),
n0 AS (SELECT lane, i, leaf AS h, count(*) OVER (PARTITION BY lane) AS n FROM a0)"""
    ]

    def level(a: str, n: str, to_a: str, to_n: str) -> None:
        steps.append(f"""r{to_n} AS (SELECT lane, i // 16 AS g, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {n} GROUP BY ALL),
{to_n} AS (SELECT lane, g AS i, h, count(*) OVER (PARTITION BY lane) AS n FROM
  (SELECT lane, g, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r{to_n})),
{to_a} AS (SELECT x.* EXCLUDE (f, proof, i, n, lt, rt), x.i // 16 AS i,
    CASE WHEN n = 1 THEN proof ELSE proof || lt || rt END AS proof, CASE WHEN n = 1 THEN f ELSE sha256(lt || f || rt) END AS f FROM
  (SELECT a.*, r.n, array_to_string(hs[1:a.i % 16], '') AS lt, array_to_string(hs[a.i % 16 + 2:], '') AS rt
   FROM {a} a JOIN r{to_n} r ON a.lane = r.lane AND a.i // 16 = r.g) x)""")

    for j in range(lane_levels):
        level(f"a{j}", f"n{j}", f"a{j + 1}", f"n{j + 1}")
    steps.append(f"""s AS (SELECT lane AS name, h AS subroot, row_number() OVER (ORDER BY lane) - 1 AS i FROM n{lane_levels}),
b0 AS (SELECT a.* EXCLUDE (lane, i), '' AS lane, s.subroot, s.i FROM a{lane_levels} a JOIN s ON a.lane = s.name),
m0 AS (SELECT '' AS lane, i, subroot AS h, count(*) OVER () AS n FROM s)""")
    for j in range(source_levels):
        level(f"b{j}", f"m{j}", f"b{j + 1}", f"m{j + 1}")
    return ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
FROM b{source_levels} b JOIN m{source_levels} m ON b.i = m.i"""
