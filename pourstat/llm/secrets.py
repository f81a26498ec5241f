"""Secret scan: known formats, and a randomness battery over opaque tokens.

One Python pass finds the known formats and measures every opaque token: symbol
coincidences (the chi-squared statistic of alphabet uniformity), runs about the alphabet's
middle, and lag-1 serial correlation. Spark then controls the false discovery rate over
all measured tokens of the table and keeps the significant ones.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import durable, prepare

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
OPAQUE = re.compile("[A-Za-z0-9+/_-]{20,}={0,2}")
#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "random")

#: Encodings, most special first; the alphabet's order gives the symbol's number.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base38": "0123456789abcdefghijklmnopqrstuvwxyz-_",
    "BASE38": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-_",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_NUMBER = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
#: Share of false discoveries that is accepted, and the z beyond which a battery test rejects.
FALSE_SHARE = 0.01
REJECT_Z = 3.3
#: Grid of z values on which the threshold is sought.
STEP = 0.05

_BASE = "array<struct<start:int,kind:int,stop:int>>"
_SEEN = "array<struct<start:int,stop:int,code:int,n:int,pairs:int,runs_z:double,serial_z:double>>"


def encoding_of(token: str) -> str | None:
    """The smallest encoding that a token fits; None for words and numbers.

    A token needs a digit and a letter; all else is left to the tests.
    """
    used = set(token.rstrip("="))
    if not any("0" <= c <= "9" for c in used) or not any("a" <= c <= "z" for c in map(str.lower, used)):
        return None
    return next((name for name, letters in _SETS.items() if used <= letters), None)


def opaque_spans(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Places of all opaque tokens, and of what known spans leave of them if it is itself long enough."""
    reach, far = [], 0  # how far the spans up to each one go
    for _, _, stop in known:
        far = max(far, stop)
        reach.append(far)
    for m in OPAQUE.finditer(text):
        a, b = m.span()
        yield a, b
        at = a
        for k in range(bisect.bisect_right(reach, a), len(known)):
            start, _, stop = known[k]
            if start >= b:
                break
            yield from ((at + x.start(), at + x.end()) for x in OPAQUE.finditer(text[at:start]) if at < start)
            at = max(at, stop)
        if a < at < b:
            yield from ((at + x.start(), at + x.end()) for x in OPAQUE.finditer(text[at:b]))


def measure(token: str, name: str) -> tuple[int, int, float, float]:
    """Length, equal symbol pairs, z of the runs and of the serial correlation under randomness."""
    number, k = _NUMBER[name], len(ALPHABETS[name])
    x = np.fromiter((number[c] for c in token.rstrip("=")), np.int64)
    n = len(x)
    counts = np.bincount(x, minlength=k)
    pairs = int((counts * (counts - 1) // 2).sum())
    high = x >= k // 2
    a, b = int(high.sum()), int(n - high.sum())
    if min(a, b) == 0:
        runs_z = 99.0
    else:
        mean = 1 + 2 * a * b / n
        var = max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
        runs_z = (1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)
    d = x - x.mean()
    power = float((d * d).sum())
    serial_z = 99.0 if power == 0 else float((d[1:] * d[:-1]).sum()) / power * math.sqrt(n)
    return n, pairs, runs_z, serial_z


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the known formats in order; leftmost, not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = list(ALPHABETS)
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    seen_type = pa.list_(
        pa.struct(
            [("start", pa.int32()), ("stop", pa.int32()), ("code", pa.int32()), ("n", pa.int32()), ("pairs", pa.int32()),
             ("runs_z", pa.float64()), ("serial_z", pa.float64())]
        )
    )
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        letters = np.zeros(256, np.int64)
        base, seen = [], []
        for t in texts:
            t = t or ""
            letters += np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)
            known = known_spans(t)
            base.append([{"start": a, "kind": k, "stop": b} for a, k, b in known])
            found = []
            for a, b in opaque_spans(t, known):
                if (name := encoding_of(t[a:b])) is not None:
                    n, pairs, runs_z, serial_z = measure(t[a:b], name)
                    found.append(
                        {"start": a, "stop": b, "code": names.index(name), "n": n, "pairs": pairs,
                         "runs_z": runs_z, "serial_z": serial_z}
                    )
            seen.append(found)
        rows = len(texts)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(base, span), pa.array(seen, seen_type), pa.nulls(rows, pa.list_(pa.int64()))],
            names=[*batch.schema.names[:-1], "base", "seen", "letters"],
        )
        # One more row carries the batch's byte counts.
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, c.type) for c in batch.columns[:-1]], pa.nulls(1, span), pa.nulls(1, seen_type),
             pa.array([letters.tolist()], pa.list_(pa.int64()))],
            names=[*batch.schema.names[:-1], "base", "seen", "letters"],
        )


def scan(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The Python pass: per row ``keep``, known spans and measured tokens, and rows of byte counts."""
    prepare(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scan, f"{kinds}base {_BASE}, seen {_SEEN}, letters array<bigint>")


def text_moments(letters: list[int]) -> dict[int, tuple[float, float]]:
    """Sums of squared and cubed symbol shares of ordinary text, by encoding number."""
    out = {}
    for code, alphabet in enumerate(ALPHABETS.values()):
        # One of each symbol is added, so that shares exist also for an empty table.
        x = np.array([letters[ord(c)] + 1 for c in alphabet], float)
        q = x / x.sum()
        out[code] = (float((q**2).sum()), float((q**3).sum()))
    return out


def text_z(seen: Column, moments: dict[int, tuple[float, float]]) -> Column:
    """How far below ordinary text a token's coincidences lie.

    Under the null that symbols are drawn as in the corpus, pairs have mean C(n,2) p2 and
    variance C(n,2) p2 (1 - p2) + n (n-1) (n-2) (p3 - p2^2); the same distance means more
    the longer the token is, so the threshold takes care of length by itself.
    """
    p2 = F.element_at(F.create_map(*[F.lit(v) for c, m in moments.items() for v in (c, m[0])]), seen["code"])
    p3 = F.element_at(F.create_map(*[F.lit(v) for c, m in moments.items() for v in (c, m[1])]), seen["code"])
    n = seen["n"].cast("double")
    c = n * (n - 1) / 2
    var = c * p2 * (1 - p2) + n * (n - 1) * (n - 2) * (p3 - p2 * p2)
    return (seen["pairs"] - c * p2) / F.sqrt(F.greatest(var, F.lit(1e-9)))


def uniform_z(seen: Column) -> Column:
    """Chi-squared of alphabet uniformity, standardised: k/n (2 pairs + n) - n has mean k - 1, variance 2 (k - 1)."""
    sizes = F.element_at(F.create_map(*[F.lit(v) for c, a in enumerate(ALPHABETS.values()) for v in (c, len(a))]), seen["code"])
    k, n = sizes.cast("double"), seen["n"].cast("double")
    return (k / n * (2 * seen["pairs"] + n) - n - (k - 1)) / F.sqrt(2 * (k - 1))


def passes_battery(seen: Column) -> Column:
    return (uniform_z(seen) <= REJECT_Z) & (F.abs(seen["runs_z"]) <= REJECT_Z) & (F.abs(seen["serial_z"]) <= REJECT_Z)


def discovery_threshold(counts: dict[int, int], total: int, share: float = FALSE_SHARE) -> float:
    """Benjamini-Hochberg over a grid: the largest z with total * P(Z <= z) <= share * (tokens at or below z)."""
    best, below = -math.inf, 0
    for cell in sorted(counts):
        below += counts[cell]
        z = (cell + 1) * STEP
        if z < 0 and total * 0.5 * math.erfc(-z / math.sqrt(2)) <= share * below:
            best = z
    return best


def learn_limit(rows: DataFrame) -> tuple[dict[int, tuple[float, float]], float]:
    """Text moments and the z threshold from all scanned rows.

    What reaches the driver is bounded: 256 byte counts and a histogram of z in steps of
    ``STEP`` from -40 to 0.
    """
    sums = rows.filter("letters IS NOT NULL").select(
        *[F.sum(F.get("letters", F.lit(i))).alias(str(i)) for i in range(256)]
    ).first()
    moments = text_moments([x or 0 for x in sums])
    cell = F.floor(text_z(F.col("t"), moments) / STEP)
    histogram = (
        rows.filter("base IS NOT NULL").select(F.explode("seen").alias("t"))
        .select(F.greatest(F.lit(-800), F.least(F.lit(0), cell)).cast("int").alias("cell"))
        .groupBy("cell").count().collect()
    )
    counts = {r["cell"]: r["count"] for r in histogram}
    return moments, discovery_threshold(counts, sum(counts.values()))


def with_spans(rows: DataFrame, moments: dict[int, tuple[float, float]], limit: float) -> DataFrame:
    """Scanned rows with ``spans``: the known ones and significant random tokens that none of them covers."""
    base = F.col("base")
    random = F.filter(
        "seen",
        lambda t: (text_z(t, moments) <= F.lit(limit))
        & passes_battery(t)
        & ~F.exists(base, lambda b: (b["start"] <= t["start"]) & (t["stop"] <= b["stop"])),
    )
    added = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    return rows.filter("base IS NOT NULL").withColumn("spans", F.array_sort(F.concat(base, added))).drop("seen", "letters")


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``base``, ``spans``: arrays of (start, kind, stop) in code points.

    ``base`` holds the known formats; ``spans`` adds random tokens that none of them covers,
    so spans may overlap. A span covers the whole match. NULL and empty texts have empty arrays; repeated rows
    repeat; an empty table stays empty. The tokens of all rows share one false discovery
    control. The scanned rows hold spans only, so they are checkpointed and the texts are
    read once; keep wide columns out of ``keep``.
    """
    rows = durable(scan(df, text, list(keep)))
    return with_spans(rows, *learn_limit(rows))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The table with every found span of ``text`` replaced by a mark and ``n_chars`` set anew.

    Overlapping spans are merged. Columns and their order stay as they are, whatever their
    names; a NULL text stays NULL; an empty table stays empty. The texts are scanned twice, for the threshold and for the spans, because a
    checkpoint of whole texts would cost more disk than the second scan costs time.
    """
    names = df.columns
    learned = learn_limit(durable(scan(df, "text", [])))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    found = with_spans(scan(df.select(row, F.col("text")), "text", ["_row"]), *learned)
    found = found.select("_row", "spans")
    body, hit = F.col("_row")["text"], F.size("spans") > 0
    # Pieces of text between the furthest end so far and the next start.
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["stop"] + 1).alias("at"),
            F.when(s["start"] + 1 >= a["at"], F.concat(a["out"], F.substr(body, a["at"], s["start"] + 1 - a["at"]), F.lit(mark)))
            .otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr(body, a["at"])),
    )
    done = found.withColumn("_text", F.when(hit, cut).otherwise(body))
    changed = {"text": F.col("_text"), "n_chars": F.when(hit, F.length("_text").cast("long")).otherwise(F.col("_row")["n_chars"] if "n_chars" in names else None)}
    return done.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in names])
