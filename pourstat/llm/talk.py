"""Repair of conversation structure by generalised LR parsing with weighted edits.

The roles of a conversation have to derive from a grammar: an optional system row, then pairs
of user and assistant. An SLR table is made from the grammar; stacks of parser states share
their tails in one graph, and a frontier maps each stack that rows so far can lead to onto its
cheapest (cost, audit). Each row is kept, given another role or deleted, and rows may be
inserted before it; edits that lead to an equal stack are merged by the minimum of
(cost, audit). Audits of equal cost are never prefixes of one another (an audit fixes its own
cost), so merging early loses nothing. The grammar is left-recursive, which keeps stacks short.

Rows: NULL role and text are one space; a role's first character is its initial, and an empty
role has none, which counts as illegal and is not kept. Rows are ordered by turn, NULL first; rows of one turn by the
MD5 of role and text, so equal rows are neighbours. Extra columns are not read. An empty table
yields no rows. Texts of any length are read whole.

Scale: rows are range-partitioned by (conversation, turn, MD5), so a conversation with a third
of all rows is spread over tasks, and equal rows are counted together before that. A task cuts
its sorted rows into blocks. A conversation that lies in one block is finished in that pass.
The others (at most two a partition, and long ones) go on as blocks: rows repeated in other blocks are
found by one aggregation, every block is summarised from each stack it can start with, the
summaries are chained, and the blocks are rendered apart. Only summaries and rendered blocks
pass one after the other through the task of a conversation, and are not held there; SHA-256
of the repaired text leaves no other order.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import checkpoint_dir, prepare, stored

#: Distinct rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 20

# The role grammar, the weights of the edits and the roles they give
GRAMMAR = (
    ("talk", ()),
    ("talk", ("turns",)),
    ("talk", ("s", "turns")),
    ("turns", ("pair",)),
    ("turns", ("turns", "pair")),
    ("pair", ("u", "a")),
)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
END = "$"

_SPOKEN = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


# --------------------------------------------------------------------------
# Parser
# --------------------------------------------------------------------------
class Stack(NamedTuple):
    """A parser state on top of another stack; equal tails are one object in the graph."""

    state: int
    below: Stack | None


class Parser:
    """SLR tables of a grammar, and steps on stacks that follow every action of a conflict."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = [("", (grammar[0][0],)), *grammar]
        self.heads = {h for h, _ in self.rules}
        self.follow = self._follow()
        self.states: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        self._build()
        self.root = Stack(0, None)
        self._steps: dict[tuple[Stack, str], tuple[Stack, ...]] = {}

    def _first(self) -> tuple[dict[str, set], set]:
        first: dict[str, set] = {h: set() for h in self.heads}
        empty: set[str] = set()
        while True:
            before = (sum(map(len, first.values())), len(empty))
            for head, body in self.rules:
                for symbol in body:
                    first[head] |= first.get(symbol, {symbol})
                    if symbol not in empty:
                        break
                else:
                    empty.add(head)
            if before == (sum(map(len, first.values())), len(empty)):
                return first, empty

    def _follow(self) -> dict[str, set]:
        first, empty = self._first()
        follow: dict[str, set] = {h: set() for h in self.heads}
        follow[""] = {END}
        while True:
            before = sum(map(len, follow.values()))
            for head, body in self.rules:
                after = set(follow[head])
                for symbol in reversed(body):
                    if symbol in self.heads:
                        follow[symbol] |= after
                        after = first[symbol] | (after if symbol in empty else set())
                    else:
                        after = {symbol}
            if before == sum(map(len, follow.values())):
                return follow

    def _close(self, items: set) -> frozenset:
        items = set(items)
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            body = self.rules[rule][1]
            if dot < len(body):
                new = {(k, 0) for k, (h, _) in enumerate(self.rules) if h == body[dot]} - items
                items |= new
                todo += new
        return frozenset(items)

    def _build(self) -> None:
        self.states = [self._close({(0, 0)})]
        for at, state in enumerate(self.states):  # grows while it is read
            for symbol in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                moved = self._close({(r, d + 1) for r, d in state if d < len(self.rules[r][1]) and self.rules[r][1][d] == symbol})
                if moved not in self.states:
                    self.states.append(moved)
                self.goto[at, symbol] = self.states.index(moved)

    def _reduced(self, stack: Stack, ahead: str) -> set[Stack]:
        """The stack and all that reductions before symbol ``ahead`` make of it."""
        seen, todo = {stack}, [stack]
        while todo:
            s = todo.pop()
            for rule, dot in self.states[s.state]:
                head, body = self.rules[rule]
                if dot == len(body) and rule and ahead in self.follow[head]:
                    base = s
                    for _ in body:
                        base = base.below
                    made = Stack(self.goto[base.state, head], base)
                    if made not in seen:
                        seen.add(made)
                        todo.append(made)
        return seen

    def step(self, stack: Stack, symbol: str) -> tuple[Stack, ...]:
        """The stacks after ``symbol``; none if the grammar does not allow it here."""
        key = (stack, symbol)
        if key not in self._steps:
            found = {Stack(self.goto[s.state, symbol], s) for s in self._reduced(stack, symbol) if (s.state, symbol) in self.goto}
            # States that can only be reduced are reduced at once, so equal stacks meet early.
            self._steps[key] = tuple(sorted({self._settle(s) for s in found}, key=str))
        return self._steps[key]

    def _settle(self, stack: Stack) -> Stack:
        while len(items := self.states[stack.state]) == 1:
            ((rule, dot),) = items
            head, body = self.rules[rule]
            if dot < len(body):
                break
            base = stack
            for _ in body:
                base = base.below
            stack = Stack(self.goto[base.state, head], base)
        return stack

    def accepts(self, stack: Stack) -> bool:
        return any((0, 1) in self.states[s.state] for s in self._reduced(stack, END))

    def all_stacks(self) -> list[Stack]:
        """Every stack that some sequence of symbols leads to, in a fixed order."""
        found = [self.root]
        for s in found:  # grows while it is read
            found += [t for x in "sua" for t in self.step(s, x) if t not in found]
        return found


@lru_cache(1)
def parser() -> tuple[Parser, list[Stack]]:
    p = Parser()
    return p, p.all_stacks()


Frontier = dict[Stack, tuple[int, str]]


def _offer(frontier: Frontier, stack: Stack, cost: int, audit: str) -> bool:
    old = frontier.get(stack)
    if old is None or (cost, audit) < old:
        frontier[stack] = (cost, audit)
        return True
    return False


def insertions(frontier: Frontier) -> Frontier:
    """The frontier with every cheaper way over inserted rows."""
    p, _ = parser()
    out = dict(frontier)
    todo = list(out)
    while todo:
        s = todo.pop()
        cost, audit = out[s]
        for symbol in ROLE:
            for t in p.step(s, symbol):
                if _offer(out, t, cost + INSERT, audit + "I"):
                    todo.append(t)
    return out


def row_edits(frontier: Frontier, initial: str, fault: str, copies: int) -> Frontier:
    """The frontier after one row and ``copies - 1`` repetitions of it, which have to go."""
    p, _ = parser()
    if fault in ("blank", "duplicate"):
        return {s: (c + DELETE * copies, a + "D" * copies) for s, (c, a) in frontier.items()}
    out: Frontier = {}
    extra = TRUNCATED if fault == "truncated" else 0
    for s, (cost, audit) in insertions(frontier).items():
        _offer(out, s, cost + DELETE, audit + "D")
        for symbol in "sua":
            for t in p.step(s, symbol):
                if symbol == initial:
                    _offer(out, t, cost + KEEP + extra, audit + "K")
                if symbol in ROLE:
                    _offer(out, t, cost + REROLE + extra, audit + "R")
    if copies > 1:
        more = copies - 1
        out = {s: (c + DELETE * more, a + "D" * more) for s, (c, a) in out.items()}
    return out


# --------------------------------------------------------------------------
# Blocks
# --------------------------------------------------------------------------
class Entry(NamedTuple):
    """Equal neighbouring rows of a conversation."""

    turn: int | None
    key: bytes
    role: str
    text: str
    copies: int


class Tally(NamedTuple):
    """What a stretch of rows counts; ``joined`` adds the stretch that follows."""

    rows: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None

    def joined(self, o: Tally) -> Tally:
        if not o.rows:
            return self
        if not self.rows:
            return o
        again = self.high is not None and self.high == o.low
        return Tally(
            self.rows + o.rows, o.low if self.low is None else self.low, self.high if o.high is None else o.high,
            self.turns + o.turns - again, self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated,
            self.illegal + o.illegal + (self.last + o.first not in LEGAL), self.first, o.last,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def faults(entries: list[Entry], seen: Iterable[bytes]) -> list[str]:
    """First fault of each entry's first row; repetitions of a row that is not blank are duplicates."""
    seen, out = set(seen), []
    for e in entries:
        last = _LAST.search(e.text) if _SPOKEN.search(e.text) else None
        if last is None:
            out.append("blank")
        elif e.key in seen:
            out.append("duplicate")
        else:
            out.append("" if last.group() in ".!?" else "truncated")
        seen.add(e.key)
    return out


def tally(entries: list[Entry], found: list[str]) -> Tally:
    out = Tally()
    for e, fault in zip(entries, found):
        more = e.copies - 1
        initial = e.role[:1]
        known = e.turn is not None
        blank = e.copies if fault == "blank" else 0
        twice = 0 if blank else more + (fault == "duplicate")
        out = out.joined(
            Tally(e.copies, e.turn, e.turn, int(known), blank, twice, int(fault == "truncated"), more, initial, initial)
        )
    return out


def summarise(entries: list[Entry], found: list[str], starts: Iterable[Stack]) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit) of the cheapest edits of the entries from every start."""
    _, stacks = parser()
    number = {s: k for k, s in enumerate(stacks)}
    out = []
    for start in starts:
        frontier: Frontier = {start: (0, "")}
        for e, fault in zip(entries, found):
            frontier = row_edits(frontier, e.role[:1], fault, e.copies)
        out += [(number[start], number[s], c, a) for s, (c, a) in frontier.items()]
    return out


def finish(frontier: Frontier) -> tuple[Stack, int, str]:
    """The cheapest way to an end that the grammar accepts, rows inserted there included."""
    p, _ = parser()
    ends = [(c, a, s) for s, (c, a) in insertions(frontier).items() if p.accepts(s)]
    cost, audit, stack = min(ends, key=lambda x: x[:2])
    return stack, cost, audit


def render(entries: list[Entry], audit: str, start: Stack) -> tuple[list[str], Stack]:
    """Repaired rows ``role:text`` of a block by the edits of its audit."""
    p, _ = parser()
    rows, at, stack = [], 0, start
    copies = iter(entries)
    entry, left = None, 0

    def moved(symbols: str) -> str:
        nonlocal stack
        symbol = next(x for x in symbols if p.step(stack, x))
        stack = p.step(stack, symbol)[0]
        return symbol

    for at, edit in enumerate(audit):
        if edit == "I":
            rows.append(ROLE[moved("ua")] + ":")
            continue
        if not left:
            entry = next(copies)
            left = entry.copies
        left -= 1
        if edit == "K":
            moved(entry.role[:1])
            rows.append(f"{entry.role}:{entry.text}")
        elif edit == "R":
            rows.append(f"{ROLE[moved('ua')]}:{entry.text}")
    return rows, stack


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


# --------------------------------------------------------------------------
# Spark
# --------------------------------------------------------------------------
def damaged(talks: DataFrame) -> DataFrame:
    """lane, conv_id, turn, role, text, copies (0: dropped) and key of the damaged rows."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in ("conv_id", "turn", "role", "text"))
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = talks.select(
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("lane"),
        conv.alias("conv_id"),
        turn.cast("long").alias("turn"),
        mark.alias("mark"),
        F.when(mark == 4, F.lit("user")).otherwise(spaced(role)).alias("role"),
        F.when(mark.isin(0, 1), F.lit("")).when(mark == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text)).alias("text"),
        F.when(mark == 0, 0).when(mark == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.withColumn("key", F.when(F.col("copies") > 0, key).otherwise(F.lit(b""))).drop("mark")


def _count_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch become one row with their number."""
    for batch in batches:
        first: dict[tuple, int] = {}
        count: dict[tuple, int] = {}
        names = ("lane", "turn", "key", "copies")
        for k, (lane, turn, key, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            first.setdefault((lane, turn, key), k)
            count[lane, turn, key] = count.get((lane, turn, key), 0) + copies
        if len(first) < batch.num_rows:
            batch = batch.take(pa.array(first.values(), pa.int64()))
            at = batch.schema.get_field_index("copies")
            batch = batch.set_column(at, "copies", pa.array(count.values(), pa.int64()))
        yield batch


RESULT = [
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
]
RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ENTRY = pa.struct([("turn", pa.int64()), ("key", pa.binary()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())])
_ENTRY_DDL = "array<struct<turn: long, key: binary, role: string, text: string, copies: long>>"


def _complete(entries: list[Entry]) -> list:
    """The result of a conversation that lies in one block."""
    found = faults(entries, ())
    t = tally(entries, found)
    p, stacks = parser()
    ways = {stacks[end]: (cost, audit) for _, end, cost, audit in summarise(entries, found, [p.root])}
    _, cost, audit = finish(ways)
    rows, _ = render(entries, audit, p.root)
    return [t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, cost, audit, hashlib.sha256(utf8("\n".join(rows))).hexdigest()]


def _blocks(conv_type: pa.DataType, block_rows: int, block_chars: int):
    """Sorted rows to finished conversations and open blocks."""
    schema = pa.schema(
        [("lane", pa.string()), ("conv_id", conv_type), ("part", pa.int32()), ("seq", pa.int32()), ("done", pa.bool_()), *RESULT, ("entries", pa.list_(_ENTRY))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lane, conv, entries, size, seq, at_edge = None, None, [], 0, 0, True
        out: list[list] = []
        nothing = [None] * len(RESULT)

        def emit(last_of_lane: bool) -> None:
            nonlocal entries, size, seq
            if last_of_lane and not at_edge and seq == 0:
                out.append([lane, conv, part, 0, True, *_complete(entries), None])
            else:
                out.append([lane, conv, part, seq, False, *nothing, [e._asdict() for e in entries]])
                seq += 1
            entries, size = [], 0

        for batch in batches:
            names = ("lane", "conv_id", "turn", "key", "role", "text", "copies")
            for name, ident, turn, key, role, text, copies in zip(*(batch.column(c).to_pylist() for c in names)):
                if name != lane:
                    if lane is not None:
                        emit(True)
                        at_edge = False
                    lane, conv, seq = name, ident, 0
                if not copies:
                    continue
                if entries and entries[-1].turn == turn and entries[-1].key == key:
                    entries[-1] = entries[-1]._replace(copies=entries[-1].copies + copies)
                    continue
                if entries and (len(entries) >= block_rows or size + len(text) > block_chars):
                    emit(False)
                entries.append(Entry(turn, key, role, text, copies))
                size += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out.clear()
        if lane is not None:
            # The next partition may go on with this conversation.
            at_edge = True
            emit(False)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return cut


_TALLY_DDL = "rows long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_WAYS_DDL = "array<struct<start: int, end: int, cost: long, audit: string>>"
SUMMARY_DDL = f"lane string, conv_id {{conv}}, part int, seq int, tally struct<{_TALLY_DDL.replace(' ', ': ').replace(',: ', ', ')}>, ways {_WAYS_DDL}"


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _entries(block: dict) -> list[Entry]:
    return [Entry(**e) for e in block["entries"]]


def _summaries(schema: pa.Schema):
    def run(batches):
        _, stacks = parser()
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                entries = _entries(b)
                found = faults(entries, b["seen"] or ())
                ways = [dict(zip(("start", "end", "cost", "audit"), w)) for w in summarise(entries, found, stacks)]
                head = {k: b[k] for k in ("lane", "conv_id", "part", "seq")}
                rows.append({**head, "tally": tally(entries, found)._asdict(), "ways": ways})
            if rows:
                yield _rows(schema, rows)

    return run


CHAIN_DDL = f"lane string, conv_id {{conv}}, part int, seq int, start int, end int, closing string, {RESULT_DDL}"


def _chain(schema: pa.Schema):
    """Summaries in order to one row per block (where its best way starts and ends) and one per conversation.

    Held per conversation: the counts, one number per block and stack, and the audits behind
    their common beginning.
    """

    def total(lane, conv, t, places, back, frontier, begun):
        p, stacks = parser()
        number = {s: k for k, s in enumerate(stacks)}
        # The end is reached from one of the open stacks; rows inserted there belong to the last block.
        best = min((finish({s: way})[1:] + (number[s],) for s, way in frontier.items() if _can_finish(s)), key=lambda x: x[:2])
        cost, tail, at = best
        closing = tail[len(frontier[stacks[at]][1]) :]
        path = [at]
        for pointers in reversed(back):
            path.append(pointers[path[-1]])
        path.reverse()
        nothing = dict.fromkeys([n for n, _ in RESULT])
        for k, (part, seq) in enumerate(places):
            last = k + 1 == len(places)
            yield {"lane": lane, "conv_id": conv, "part": part, "seq": seq, "start": path[k], "end": path[k + 1], "closing": closing if last else "", **nothing}
        yield {
            "lane": lane, "conv_id": conv, "part": None, "seq": None, "start": None, "end": None, "closing": None, "gaps": t.gaps,
            "blank": t.blank, "duplicate": t.duplicate, "truncated": t.truncated, "illegal": t.illegal, "cost": cost,
            "audit": "".join(begun) + tail, "repaired_sha256": None,
        }

    def run(batches):
        p, stacks = parser()
        lane = None
        for batch in batches:
            out: list[dict] = []
            for b in batch.to_pylist():
                if b["lane"] != lane:
                    if lane is not None:
                        out += total(lane, conv, t, places, back, frontier, begun)
                    lane, conv, t, places, back = b["lane"], b["conv_id"], Tally(), [], []
                    frontier, begun = {p.root: (0, "")}, []
                t = t.joined(Tally(**b["tally"]))
                reached: dict[Stack, tuple[int, str]] = {}
                came: dict[int, int] = {}
                for w in b["ways"]:
                    before = frontier.get(stacks[w["start"]])
                    if before is not None and _offer(reached, stacks[w["end"]], before[0] + w["cost"], before[1] + w["audit"]):
                        came[w["end"]] = w["start"]
                places.append((b["part"], b["seq"]))
                back.append(came)
                common = os.path.commonprefix([a for _, a in reached.values()])
                begun.append(common)
                frontier = {s: (c, a[len(common) :]) for s, (c, a) in reached.items()}
            if out:
                yield _rows(schema, out)
        if lane is not None:
            yield _rows(schema, list(total(lane, conv, t, places, back, frontier, begun)))

    return run


def _can_finish(stack: Stack) -> bool:
    p, _ = parser()
    return any(p.accepts(s) for s in insertions({stack: (0, "")}))


BODY_DDL = "lane string, part int, seq int, n long, body binary"


def _bodies(schema: pa.Schema):
    def run(batches):
        _, stacks = parser()
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                lines, _ = render(_entries(b), b["audit"] + b["closing"], stacks[b["start"]])
                rows.append({"lane": b["lane"], "part": b["part"], "seq": b["seq"], "n": len(lines), "body": utf8("\n".join(lines))})
            if rows:
                yield _rows(schema, rows)

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered blocks in order to one digest per conversation."""
    schema = pa.schema([("lane", pa.string()), ("repaired_sha256", pa.string())])
    lane, digest, begun = None, None, False
    for batch in batches:
        out = []
        for name, n, body in zip(*(batch.column(c).to_pylist() for c in ("lane", "n", "body"))):
            if name != lane:
                if lane is not None:
                    out.append({"lane": lane, "repaired_sha256": digest.hexdigest()})
                lane, digest, begun = name, hashlib.sha256(), False
            if n:
                digest.update(b"\n" + body if begun else body)
                begun = True
        if out:
            yield _rows(schema, out)
    if lane is not None:
        yield _rows(schema, [{"lane": lane, "repaired_sha256": digest.hexdigest()}])


def _arrow(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def repair(talks: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """conv_id, counts of faults, cost, audit and digest of the repaired text per conversation.

    Conversations of which no row is left count zero, with an empty audit and the digest of
    nothing.
    """
    spark = talks.sparkSession
    prepare(spark)
    folder = f"{checkpoint_dir(spark)}/talk-{uuid.uuid4().hex}"
    rows = damaged(talks)
    conv = dict(rows.dtypes)["conv_id"]
    conv_arrow = _arrow(rows.select("conv_id").schema).types[0]
    shown = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    order = ["lane", "turn", "key"]
    placed = rows.mapInArrow(_count_equal, shown).repartitionByRange(*order).sortWithinPartitions(*order)
    cut_ddl = f"lane string, conv_id {conv}, part int, seq int, done boolean, {RESULT_DDL}, entries {_ENTRY_DDL}"
    cut = stored(placed.mapInArrow(_blocks(conv_arrow, block_rows, block_chars), cut_ddl), folder, "blocks")
    open_blocks = cut.filter(~F.col("done")).select("lane", "conv_id", "part", "seq", "entries")
    place = ["lane", "part", "seq"]

    # Rows that an earlier block of the conversation has as well.
    contents = open_blocks.select(*place, F.explode(F.array_distinct(F.col("entries.key"))).alias("key"))
    repeated = contents.groupBy("lane", "key").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = contents.join(repeated, ["lane", "key"]).filter(F.struct("part", "seq") != F.col("first"))
    seen = later.groupBy(*place).agg(F.collect_list("key").alias("seen"))
    summary_ddl = SUMMARY_DDL.format(conv=conv)
    summaries = open_blocks.join(seen, place, "left")
    summaries = stored(summaries.mapInArrow(_summaries(_ddl_arrow(spark, summary_ddl)), summary_ddl), folder, "summaries")

    chain_ddl = CHAIN_DDL.format(conv=conv)
    chained = summaries.repartition("lane").sortWithinPartitions(*place).mapInArrow(_chain(_ddl_arrow(spark, chain_ddl)), chain_ddl)
    chained = stored(chained, folder, "ways")
    chosen = chained.filter("part IS NOT NULL").select(*place, "start", "end", "closing")
    way = F.filter("ways", lambda w: (w["start"] == F.col("start")) & (w["end"] == F.col("end")))[0]
    segments = summaries.join(chosen, place).select(*place, "start", "closing", way["audit"].alias("audit"))
    bodies = open_blocks.join(segments, place).mapInArrow(_bodies(_ddl_arrow(spark, BODY_DDL)), BODY_DDL)
    hashes = bodies.repartition("lane").sortWithinPartitions(*place).mapInArrow(_hashes, "lane string, repaired_sha256 string")
    names = ["conv_id", *[n for n, _ in RESULT]]
    totals = chained.filter("part IS NULL").drop("repaired_sha256").join(hashes, "lane").select(*names)
    return cut.filter("done").select(*names).unionByName(totals)


def _ddl_arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.types import _parse_datatype_string

    return _arrow(_parse_datatype_string(ddl))


# --------------------------------------------------------------------------
# The same in SQL
# --------------------------------------------------------------------------
def oracle() -> str:
    """The same rows in DuckDB SQL: a recursive search over (row, state) instead of a parser."""
    from pourstat.llm.merkle import CRC32_SQL

    crc = CRC32_SQL.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    # State 0: nothing yet, 1: after system, 2: after user, 3: after assistant.
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    hops = {s: [(s, "", "")] for s in range(4)}
    for s in hops:
        at, audit, body = s, "", ""
        for _ in range(3):
            symbol = "a" if at == 2 else "u"
            at, audit, body = 2 if symbol == "u" else 3, audit + "I", body + f"{ROLE[symbol]}:\n"
            hops[s].append((at, audit, body))
    moves = []
    for s, ways in hops.items():
        for at, audit, body in ways:
            paid = INSERT * len(audit)
            moves.append((s, at, "D", paid + DELETE, audit + "D", body, "", False))
            for (state, symbol), to in after.items():
                if state == at:
                    moves.append((s, to, "K", paid + KEEP, audit + "K", body, symbol, True))
                    if symbol in ROLE:
                        moves.append((s, to, "R", paid + REROLE, audit + "R", body, ROLE[symbol], True))
    quoted = lambda v: str(v) if not isinstance(v, str) else "'" + v.replace("\n", "' || chr(10) || '") + "'"
    table = ",\n".join("(" + ", ".join(map(quoted, m)) + ")" for m in moves)
    ends = ",\n".join(
        f"({s}, {INSERT * len(audit)}, {quoted(audit)}, {quoted(body)})" for s, ways in hops.items() for at, audit, body in ways if at in (0, 3)
    )
    return rf"""WITH RECURSIVE m(s, t, op, c, a, b, x, stays) AS (VALUES {table}),
e(s, c, a, b) AS (VALUES {ends}),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS mark,
  dense_rank() OVER (ORDER BY conv_id) AS lane FROM conversations),
r AS (SELECT lane, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role,
  CASE mark WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, (VALUES (1), (2)) AS copy(n) WHERE mark <> 0 AND (n = 1 OR mark = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS i FROM r),
f AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY lane ORDER BY i) AS before,
  row_number() OVER (PARTITION BY lane, role, text ORDER BY i) AS nth FROM o),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM f),
p(lane, i, s, way) AS (
  SELECT DISTINCT lane, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': '', 'b': ''}} FROM d
  UNION ALL
  SELECT p.lane, p.i + 1, m.t, min({{'c': way.c + m.c + CASE WHEN stays AND fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, 'a': way.a || m.a,
    'b': way.b || m.b || CASE m.op WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE m.x || ':' || text || chr(10) END}})
  FROM p JOIN g ON g.lane = p.lane AND g.i = p.i + 1 JOIN m ON m.s = p.s
  WHERE (m.op <> 'K' OR m.x = g.initial) AND (NOT stays OR fault NOT IN ('blank', 'duplicate')) GROUP BY p.lane, p.i, m.t),
n AS (SELECT lane, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT lane FROM d) LEFT JOIN g USING (lane) GROUP BY lane),
z AS (SELECT lane, min({{'c': way.c + e.c, 'a': way.a || e.a, 'b': way.b || e.b}}) AS z FROM p JOIN n USING (lane) JOIN e ON e.s = p.s
  WHERE p.i = n.n GROUP BY lane)
SELECT DISTINCT conv_id, gaps, blank, duplicate, truncated, illegal, z.z.c AS cost, z.z.a AS audit,
  sha256(CASE WHEN z.z.b = '' THEN '' ELSE left(z.z.b, length(z.z.b) - 1) END) AS repaired_sha256
FROM d JOIN n USING (lane) JOIN z USING (lane)"""
