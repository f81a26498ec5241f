"""Conversation repair against exhaustive search and against SQL, in one block and in many."""

import hashlib
import heapq
import re
import zlib

import duckdb
import numpy as np
import pytest

from pourstat.llm import talk

DDL = "conv_id bigint, turn bigint, role string, text string"
VALID = re.compile(r"(s?(ua)+)?")
BEGUN = re.compile(r"s?(ua)*u?")


def search(rows):
    """Cheapest (cost, audit, repaired) by trying edits in order of (cost, audit)."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if at == len(rows) and VALID.fullmatch(initials):
            return cost, audit, out
        options = [(5, "I", at, x[0], f"{x}:") for x in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            options.append((2, "D", at + 1, "", None))
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if role[:1]:
                    options.append((extra, "K", at + 1, role[:1], f"{role}:{text}"))
                options += [(1 + extra, "R", at + 1, x[0], f"{x}:{text}") for x in ("user", "assistant")]
        for more, edit, to, initial, shown in options:
            if BEGUN.fullmatch(initials + initial):
                heapq.heappush(heap, (cost + more, audit + edit, to, initials + initial, out if shown is None else (*out, shown)))


def brute(table):
    result = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            show = lambda v: " " if v is None else str(v)
            mark = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            role, text = show(role), show(text)
            text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
            role = "user" if mark == 4 else role
            rows += [(turn, role, text)] * (0 if mark == 0 else 2 if mark == 3 else 1)
        tie = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
        seen, marked = set(), []
        for _, role, text in rows:
            spoken = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not spoken else "duplicate" if (role, text) in seen else "truncated" if spoken[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, out = search(marked)
        turns = {r[0] for r in rows} - {None}
        count = lambda f: sum(m[2] == f for m in marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        result.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest))
    return sorted(result, key=str)


def awkward():
    rng = np.random.default_rng(11)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "uber"]
    texts = ["Yes.", "No", "Why?", "", None, " \t", "Go on! ", "é…", "Well. \x0b", "x.\n"]
    rows = []
    for conv in range(120):
        for turn in range(int(rng.integers(0, 6))):
            at = None if rng.random() < 0.1 else int(turn + rng.integers(0, 2))
            rows.append((conv, at, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (-5, None, None, None), (-6, None, "assistant", "Hello.")]
    rows += [(-7, 3, "user", "Again."), (-7, 3, "user", "Again."), (-7, 4, "assistant", "Sure.")]
    return rows


def run(df, **options):
    return sorted((tuple(r) for r in talk.repair(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"block_rows": 1}, {"block_rows": 2, "block_chars": 3}])
def test_repair_matches_exhaustive_search(spark, options):
    rows = awkward()
    assert run(spark.createDataFrame(rows, DDL).repartition(4), **options) == brute(rows)


def long_rows():
    rng = np.random.default_rng(2)
    rows = []
    for conv, n in ((1, 400), (2, 90), (3, 7), (4, 1)):
        for turn in range(n):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.8 else ["system", "user", "tool"][rng.integers(3)]
            text = f"Turn {rng.integers(60) if turn % 3 == 0 else turn}" + [".", "", "!"][rng.integers(3)]
            rows.append((conv, turn - 3, role, text))
    # One row repeated a great many times, some of them in one turn.
    return rows + [(2, 500, "user", "Same.")] * 60 + [(2, 501 + k, "user", "Same.") for k in range(30)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 5}, {"block_rows": 64, "block_chars": 100}])
def test_long_conversations_match_sql(spark, options):
    rows = long_rows()
    df = spark.createDataFrame(rows, DDL).repartition(6)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert run(df, **options) == sorted(con.execute(talk.oracle()).fetchall(), key=str)


def test_empty_table_and_extra_columns(spark):
    assert talk.repair(spark.createDataFrame([], DDL)).count() == 0
    names = ("lane", "key", "copies", "mark", "part", "seq", "done", "audit", "cost", "entries", "way")
    rows = awkward()[:60]
    wide = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], DDL + "".join(f", {n} string" for n in names))
    assert run(wide) == run(spark.createDataFrame(rows, DDL))


def test_text_ids(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), ("b", 7, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert {r.conv_id for r in talk.repair(df).collect()} == {"a", "b"}


def test_parser_accepts_the_grammar_only():
    import itertools

    p, stacks = talk.parser()
    assert len(stacks) == 8
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            frontier = {p.root}
            for x in word:
                frontier = {t for s in frontier for t in p.step(s, x)}
            assert any(map(p.accepts, frontier)) == bool(VALID.fullmatch(word))
