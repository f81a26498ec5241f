"""Column expressions. Every function takes and returns Columns; none runs a job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pourstat import schema as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """Condition as 0/1; NULL counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def known_true(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))


def count_if(condition: Column) -> Column:
    return F.sum(flag(condition)).cast("long")


def safe_div(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; NULL where the denominator is zero or missing."""
    return col(numerator).cast("double") / F.nullif(col(denominator).cast("double"), F.lit(0.0))


def percent2(part: Column, whole: Column) -> Column:
    """100 * part / whole of two counts to 2 decimals, half away from zero."""
    return F.round(safe_div(part.cast("double") * F.lit(10000.0), whole)) / F.lit(100.0)


def round_even(c: Column | str, digits: int) -> Column:
    """Half-even rounding on the scaled value, the usual float array rule."""
    scale = F.lit(float(10**digits))
    return F.rint(col(c) * scale) / scale


def percent_even(part: Column, whole: Column) -> Column:
    """100 * part / whole to 2 decimals by the float array rule."""
    return round_even(safe_div(part.cast("double") * F.lit(100.0), whole), 2)


# --------------------------------------------------------------------------
# Text
# --------------------------------------------------------------------------
def clean_text(c: Column | str) -> Column:
    """Trimmed text, blank as NULL."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def null_tokens(c: Column | str, tokens: Sequence[str] = tuple(S.NULL_TOKENS)) -> Column:
    """Trimmed text; any of the tokens becomes NULL."""
    trimmed = F.trim(col(c))
    return F.when(~trimmed.isin(*tokens), trimmed)


def category(c: Column | str, missing: str = S.MISSING_CATEGORY) -> Column:
    """Upper-case text with single spaces; missing and blank become a token."""
    text = F.regexp_replace(F.upper(F.trim(col(c).cast("string"))), r"\s+", " ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(missing))


def comparison_value(c: Column | str) -> Column:
    """As ``category`` but NULL where nothing is left."""
    text = F.regexp_replace(F.upper(F.trim(col(c).cast("string"))), r"\s+", " ")
    return F.nullif(text, F.lit(""))


def group_value(c: Column | str) -> Column:
    """Group key: no white space, upper case, no leading zeros in digit-only text."""
    raw = F.trim(col(c).cast("string"))
    compact = F.upper(F.translate(raw, " \t\n\x0b\f\r", ""))
    only_digits = F.translate(compact, "0123456789", "") == ""
    digits = F.coalesce(F.nullif(F.ltrim(compact, F.lit("0")), F.lit("")), F.lit("0"))
    value = F.when(only_digits, digits).otherwise(compact)
    return F.when(~F.lower(raw).isin("", "nan", "none", "<na>"), value)


def curing_text(c: Column | str) -> Column:
    """Free curing text reduced to lower-case words from a fixed character set."""
    words = F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", " ")
    return F.nullif(F.regexp_replace(words, r"[^a-z0-9%+./ -]", ""), F.lit(""))


def joined_key(cols: Sequence[Column], missing: str | None = None) -> Column:
    """Columns joined with ``|``; with ``missing`` NULL parts are spelled out."""
    parts = [c.cast("string") for c in cols]
    if missing is not None:
        parts = [F.coalesce(c, F.lit(missing)) for c in parts]
    return F.concat_ws("|", *parts)


def project_group(project: Column | str, test_id: Column | str) -> Column:
    """Project key; a test without a project forms a group of its own."""
    own = F.concat(F.lit("MISSING_PROJECT_TEST_"), col(test_id).cast("string"))
    return F.coalesce(clean_text(col(project).cast("string")), own)


def reasons(named: Iterable[tuple[str, Column]]) -> Column:
    """Names of all true conditions in the given order, ``;``-joined, or NULL."""
    parts = [F.when(condition, F.lit(name)) for name, condition in named]
    return F.nullif(F.concat_ws(";", *parts), F.lit(""))


# --------------------------------------------------------------------------
# Parsing
# --------------------------------------------------------------------------
def number(c: Column | str) -> Column:
    """Text to double, thousands separators removed; unusable text and NaN are NULL."""
    text = F.trim(F.replace(col(c).cast("string"), F.lit(","), F.lit("")))
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def flag_value(c: Column | str) -> Column:
    """Bit-like text to 0/1; anything unknown is NULL."""
    text = F.lower(F.trim(col(c).cast("string")))
    num = text.try_cast("double")
    return (
        F.when(num.isin(0.0, 1.0), num.cast("int"))
        .when(text.isin(*S.FLAG_TRUE_TOKENS), F.lit(1))
        .when(text.isin(*S.FLAG_FALSE_TOKENS), F.lit(0))
    )


def truthy(c: Column | str) -> Column:
    """Boolean text; anything but a true token is false."""
    return known_true(F.lower(F.trim(col(c).cast("string"))).isin(*S.TRUE_TOKENS))


def day(c: Column | str) -> Column:
    """Text to date; invalid text is NULL."""
    return col(c).cast("string").try_cast("date")


def in_range(c: Column | str, low: float, high: float) -> Column:
    """Value kept inside the closed range, NULL outside it."""
    return F.when(col(c).between(F.lit(low), F.lit(high)), col(c))


def outside(c: Column | str, low: float, high: float) -> Column:
    """True for a present value outside the closed range."""
    return known_true(~col(c).between(F.lit(low), F.lit(high)))


def valid_day(c: Column | str, first: str, last: str) -> Column:
    """Date inside ``[first, last]`` with both days included, as a condition."""
    return known_true(
        (col(c) >= F.lit(first).cast("date"))
        & (col(c) < F.date_add(F.lit(last).cast("date"), 1))
    )


# --------------------------------------------------------------------------
# Measurement rules
# --------------------------------------------------------------------------
def usable(value: Column | str, na_flag: Column | str) -> Column:
    """A value is present and not flagged as not applicable."""
    return (F.coalesce(col(na_flag), F.lit(0)) == 0) & col(value).isNotNull()


def unless_na(value: Column | str, na_flag: Column | str) -> Column:
    return F.when(F.coalesce(col(na_flag), F.lit(0)) != 1, col(value))


def effective_value(m: S.Measurement) -> Column:
    """After-SP reading where usable, else the actual reading, else NULL."""
    return F.when(
        usable(f"{m.raw}_afterSP", f"{m.raw}_afterSPNA"), F.col(f"{m.raw}_afterSP")
    ).when(usable(f"{m.raw}_actual", f"{m.raw}_actualNA"), F.col(f"{m.raw}_actual"))


def effective_source(m: S.Measurement) -> Column:
    return F.when(
        usable(f"{m.raw}_afterSP", f"{m.raw}_afterSPNA"), F.lit("AfterSP")
    ).when(usable(f"{m.raw}_actual", f"{m.raw}_actualNA"), F.lit("Actual"))


def out_of_spec(m: S.Measurement) -> Column:
    """1 outside a usable limit, 0 inside, NULL where nothing can be compared."""
    value = F.col(m.effective)
    low = F.when(usable(f"{m.raw}_specMin", f"{m.raw}_specMinNA"), F.col(f"{m.raw}_specMin"))
    high = F.when(usable(f"{m.raw}_specMax", f"{m.raw}_specMaxNA"), F.col(f"{m.raw}_specMax"))
    comparable = value.isNotNull() & F.coalesce(low, high).isNotNull()
    return F.when(comparable, flag(known_true(value < low) | known_true(value > high)))


def any_out_of_spec(flags: Sequence[Column]) -> Column:
    """1 if any flag is 1, 0 if any flag is known, else NULL."""
    return F.greatest(*flags)


def has_any(cols: Sequence[Column | str]) -> Column:
    return F.coalesce(*[col(c) for c in cols]).isNotNull()


def elapsed_minutes(start: Column | str, end: Column | str, wrap: bool = True) -> Column:
    """Minute boundaries crossed; with ``wrap`` a negative span passes midnight."""
    minutes = F.timestamp_diff(
        "MINUTE", F.date_trunc("minute", col(start)), F.date_trunc("minute", col(end))
    )
    if not wrap:
        return minutes
    return F.when(minutes < 0, minutes + S.MINUTES_PER_DAY).otherwise(minutes)


def clock_minutes(start: Column | str, end: Column | str) -> Column:
    """Minutes between two ``HH:mm:ss`` texts without a midnight wrap."""

    def seconds(c: Column | str) -> Column:
        part = F.split(F.trim(col(c)), ":")
        hms = [F.get(part, F.lit(i)).try_cast("int") for i in range(3)]
        return hms[0] * 3600 + hms[1] * 60 + hms[2]

    return (seconds(end) - seconds(start)) / F.lit(60.0)


def below_amount(actual: Column | str, limit: Column | str) -> Column:
    """How far a value lies below a limit, 0 at or above it, NULL if unknown."""
    gap = col(limit) - col(actual)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))


def failure(actual: Column | str, required: Column | str) -> Column:
    """1 below the requirement, 0 at or above it, NULL if either is missing."""
    return (col(actual) < col(required)).cast("int")


# --------------------------------------------------------------------------
# Bands
# --------------------------------------------------------------------------
def band(
    c: Column | str, edges: Sequence[float], labels: Sequence[str], right: bool = False
) -> Column:
    """Label of the interval holding the value.

    ``edges`` has one more entry than ``labels``; intervals are closed on the left,
    or on the right with ``right``. Values outside all intervals are NULL.
    """
    out = None
    for label, low, high in zip(labels, edges[:-1], edges[1:]):
        if right:
            inside = (col(c) > F.lit(float(low))) & (col(c) <= F.lit(float(high)))
        else:
            inside = (col(c) >= F.lit(float(low))) & (col(c) < F.lit(float(high)))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def thousands(c: Column | str) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(F.rint(col(c)), 0)


def group_label() -> Column:
    return F.concat(
        F.col("SupplierName"),
        F.lit(" | Plant "),
        F.col("plantNumber"),
        F.lit(" | Mix "),
        F.col("mixNumber"),
        F.lit(" | Req "),
        thousands("RequiredStrength"),
    )


def candidate_message(months: int) -> Column:
    """One sentence per review candidate."""
    failures = F.when(F.col("FailureCount") == 0, F.lit("no below-required results")).otherwise(
        F.concat(
            F.col("FailureCount").cast("string"),
            F.lit(" below-required result(s), a "),
            F.format_number(round_even("FailureRatePct", 1), 1),
            F.lit("% rate"),
        )
    )
    return F.concat(
        F.lit(f"Over the past {months} months, "),
        F.col("SupplierName"),
        F.lit(" Plant "),
        F.col("plantNumber"),
        F.lit(" Mix "),
        F.col("mixNumber"),
        F.lit(" averaged "),
        thousands("MeanMarginPsi"),
        F.lit(" psi above its "),
        thousands("RequiredStrength"),
        F.lit("-psi required 28-day strength across "),
        F.col("TestCount").cast("string"),
        F.lit(" valid tests. The lower 5th-percentile margin was "),
        thousands("P05MarginPsi"),
        F.lit(" psi, with "),
        failures,
        F.lit(". This mix may be a candidate for engineering mix-design review."),
    )
