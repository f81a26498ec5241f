"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import words_of

SYMBOLS = "#*$%&|<>"
#: Marks of shouting, set words or lists; counted per word by the rules below.
SHOUTS = "!"
WHITE = " \t\n\x0b\x0c\r"

#: Frequent function words of English, German, French and Spanish, in lower case.
STOP_WORDS = tuple(
    "the of and to in a is that it for on was be with as by are this from at or an not have but "
    "der die und den von das mit sich des auf ist im dem nicht ein eine für auch es als zu "
    "de la le et les en un une est que qui dans pour sur du au par pas plus "
    "el los las por se con una su al lo como para y o".split()
)


class Rule(NamedTuple):
    """A text passes if ``low <= metric <= high``; a missing bound is not checked."""

    metric: str
    low: float | None
    high: float | None


#: The production rules. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.2),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.5),
)


def count_of(text: Column, chars: str) -> Column:
    """Occurrences of any of some characters."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _adjacent_equal(ordered: Column) -> Column:
    """Number of elements equal to the one before them in a sorted array."""
    return F.size(F.filter(ordered, lambda x, i: (i > 0) & (F.get(ordered, i - 1) == x)))


def _trigram(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_stop_words, n_shouts`` (long). A NULL or empty text has zero of each.

    Repeated three-word windows are found inside the row: window hashes that are all
    different settle most texts, and the others sort (window, position) and add up the
    words that the repeated windows cover. Nothing is shuffled. The work of a text is
    n log n in its own length.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    one = df.withColumn("_w", words_of(F.col(text)))
    two = one.withColumn(
        "_h",
        F.when(F.size("_w") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(*_trigram(F.col("_w"), i))
            )
        ),
    )
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.struct(F.concat_ws(" ", *_trigram(F.col("_w"), i)).alias("g"), i.alias("i")),
        )
    )
    three = two.withColumn(
        "_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), windows)
    ).withColumn("_l", F.sort_array(F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)))
    s = F.col("_s")
    four = three.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False))
                    | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    whole = {
        "n_words": F.size("_w"),
        "word_chars": F.length(body) - count_of(body, WHITE),
        "n_symbols": count_of(body, SYMBOLS),
        "n_lines": F.size("_l"),
        "n_dup_lines": _adjacent_equal(F.col("_l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_stop_words": F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS))),
        "n_shouts": count_of(body, SHOUTS),
    }
    # A generator hands the finished counts on, so later filters are not evaluated inside the lambdas.
    counts = F.struct(*[v.cast("long").alias(k) for k, v in whole.items()])
    own = [F.col(f"`{c}`") for c in df.columns]
    return four.select(*own, F.explode_outer(F.array(counts)).alias("_c")).select(*own, "_c.*")


def _metric(name: str) -> Column:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "shout_ratio": F.col("n_shouts") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }[name]


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """All rules of the table as one boolean expression."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (_metric(r.metric) >= F.lit(float(r.low)))
        if r.high is not None:
            verdict = verdict & (_metric(r.metric) <= F.lit(float(r.high)))
    return verdict


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouts")


def quality(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to every row.

    Each row is judged alone: NULL and empty texts have no words and fail, repeated rows
    get the same verdict, an empty table stays empty. Input columns that bear the name
    of a result column are replaced.
    """
    own = df.drop(*COUNTS, "base_failed", "kept")
    counted = base_counts(own)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & compile_rules(rules))


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their own columns."""
    names = [F.col(f"`{c}`") for c in df.columns]
    row = df.select(F.struct(*names).alias("_row"), F.col("text"))
    return quality(row, rules).filter("kept").select("_row.*")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in DuckDB SQL; lists are unnested and grouped, not searched in the row."""
    metric = {
        "n_words": "n_words",
        "mean_word_length": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "shout_ratio": "n_shouts / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    }
    tests = [f"{metric[r.metric]} >= {r.low}" for r in rules if r.low is not None]
    tests += [f"{metric[r.metric]} <= {r.high}" for r in rules if r.high is not None]
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT k, i, word || ' ' || lead(word) OVER x || ' ' || lead(word, 2) OVER x AS g
      FROM u WINDOW x AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT i + s) AS n FROM r, (VALUES (0), (1), (2)) AS o(s) GROUP BY k),
l AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM
      (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
s AS (SELECT k, count(*) AS n FROM u WHERE word IN ({stops}) GROUP BY k),
c AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines,
        coalesce(l.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(s.n, 0) AS n_stop_words,
        length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts
      FROM d JOIN w USING (k) LEFT JOIN l USING (k) LEFT JOIN rep USING (k) LEFT JOIN s USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""
