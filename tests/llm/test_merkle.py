"""The Merkle manifest against brute force, with small blocks so that several tiers occur."""

import hashlib
import zlib

import numpy as np
import pytest

from pourstat.llm import merkle

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return H(map(field, (doc_id, source, lang, n_chars, text)))


def climb(row):
    """All levels of the tree over ``row``."""
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    out = []
    for row in levels[:-1]:
        run = row[at - at % 16 : at - at % 16 + 16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf_of(*r), r) for r in rows if r[3] == s), key=lambda x: x[:3])
        trees[s] = (own, climb([o[2] for o in own]))
    top = climb([trees[s][1][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for at, (_, _, leaf, r) in enumerate(own):
            path = way(levels, at) + way(top, k)
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                lower = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                folded = leaf_of(r[0], lower, *r[2:])
            for before, after in path:
                folded = H([*before, folded, *after])
            proof = H([d for before, after in path for d in before + after])
            out.append((r[0], leaf, levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, f"Text Number {i}", "en", "hot", i) for i in rng.permutation(700).tolist()]
    rows += [(i, "ÀÉ plain" if i % 2 else None, None, f"s{i % 23}", None) for i in range(1000, 1060)]
    rows += [(None, "x", "en", None, 1), (None, "x", "en", None, 1), (None, None, None, None, None), (5, "", "", "", 0)]
    rows += [(7, "Same", "en", "hot", 4)] * 40
    rows += [(2000, "A" * 200_000, "en", "long", 200_000)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest_matches_brute_force(spark, levels):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = sorted((tuple(r) for r in merkle.proofs(df, levels).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_run_edges(spark, n):
    rows = [(i, f"T{i}", None, "only", None) for i in range(n)]
    got = sorted((tuple(r) for r in merkle.proofs(spark.createDataFrame(rows, DDL), 1).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_extra_columns(spark):
    assert merkle.proofs(spark.createDataFrame([], DDL)).count() == 0
    rows = odd_rows()[:50]
    names = ("lane", "leaf", "rank", "digest", "block", "id", "change", "row", "part", "path")
    wide = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], DDL + "".join(f", {n} string" for n in names))
    assert sorted((tuple(r) for r in merkle.proofs(wide).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("height", [1, 2, 3, 4, 5])
def test_addresses_are_a_permutation_with_whole_lower_trees(height):
    places = [merkle.address(d, np.arange(16**d), height) for d in range(height)]
    assert sorted(np.concatenate(places)) == list(range(merkle.tree_size(height)))
    upper = height // 2
    if upper:
        # Every lower subtree is one contiguous stretch behind the upper half.
        size = merkle.tree_size(height - upper)
        for tree in range(min(16**upper, 40)):
            own = np.concatenate([places[upper + d][tree * 16**d : (tree + 1) * 16**d] for d in range(height - upper)])
            assert own.min() == merkle.tree_size(upper) + tree * size and own.max() - own.min() == size - 1
