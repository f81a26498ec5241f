"""Column expressions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.functions import exprs as E
from pourstat.operators import clean as C
from pourstat.operators import extract as X


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_number_parsing(frame):
    df = frame([("1,234",), (" ",), ("abc",), ("NaN",), (" 7.5 ",), (None,), ("-3",)], "s string")
    assert column(df, E.number("s")) == [1234.0, None, None, None, 7.5, None, -3.0]


def test_flags_and_truth(frame):
    df = frame([("1",), ("0.0",), ("Yes",), (" n ",), ("2",), ("t",), (None,)], "s string")
    assert column(df, E.flag_value("s")) == [1, 0, 1, 0, None, None, None]
    assert column(df, E.truthy("s")) == [True, False, True, False, False, True, False]


def test_null_tokens_and_categories(frame):
    df = frame([(" NULL ",), ("",), ("a  b",), (None,), (" A b ",)], "s string")
    assert column(df, E.null_tokens("s")) == [None, None, "a  b", None, "A b"]
    assert column(df, E.category("s")) == ["NULL", "__MISSING__", "A B", "__MISSING__", "A B"]


def test_group_value(frame):
    df = frame([("002",), ("000",), (" a 1 ",), ("None",), (" ",), (None,), ("0a",)], "s string")
    assert column(df, E.group_value("s")) == ["2", "0", "A1", None, None, None, "0A"]


def test_missing_project_forms_own_group(frame):
    df = frame([(1, " p "), (2, None), (3, " ")], "t int, p string")
    assert column(df, E.project_group("p", "t")) == ["p", "MISSING_PROJECT_TEST_2", "MISSING_PROJECT_TEST_3"]


def test_reasons_keep_order(frame):
    df = frame([(True, True), (False, True), (False, False), (None, True)], "a boolean, b boolean")
    assert column(df, E.reasons([("A", F.col("a")), ("B", F.col("b"))])) == ["A;B", "B", None, "B"]


def test_elapsed_minutes_count_boundaries_and_wrap(frame):
    ts = dt.datetime
    df = frame(
        [(ts(2020, 1, 1, 0, 0, 59), ts(2020, 1, 1, 0, 1, 0)), (ts(2020, 1, 1, 23, 50), ts(2020, 1, 1, 0, 20)), (None, ts(2020, 1, 1))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert column(df, E.elapsed_minutes("a", "b")) == [1, 30, None]
    assert column(df, E.elapsed_minutes("a", "b", wrap=False)) == [1, -1410, None]


def test_effective_measurement_and_limits(frame):
    m = S.MEASUREMENTS[0]
    cols = ["actual", "actualNA", "afterSP", "afterSPNA", "specMin", "specMinNA", "specMax", "specMaxNA"]
    ddl = ", ".join(f"{m.raw}_{c} {'int' if c.endswith('NA') else 'double'}" for c in cols)
    df = frame(
        [
            (5.0, 0, 9.0, 1, 3.0, 0, 8.0, 0),  # after-SP not applicable
            (5.0, None, 9.0, None, 3.0, 0, 8.0, 0),  # missing flag means applicable
            (5.0, 1, None, 0, 3.0, 0, 8.0, 0),  # nothing usable
            (8.0, 0, None, 0, None, 0, 8.0, 0),  # on the only limit
            (2.0, 0, None, 0, 3.0, 1, None, 0),  # limit flagged away
        ],
        ddl,
    )
    df = df.withColumns({m.effective: E.effective_value(m), "source": E.effective_source(m)})
    out = df.withColumn("flag", E.out_of_spec(m)).select(m.effective, "source", "flag").collect()
    assert [tuple(r) for r in out] == [
        (5.0, "Actual", 0),
        (9.0, "AfterSP", 1),
        (None, None, None),
        (8.0, "Actual", 0),
        (2.0, "Actual", None),
    ]


def test_batch_moisture_rules(frame):
    rows = [
        (1, "misc sand 1", 100.0, 0.0),
        (1, "MISC SAND 2", 50.0, None),
        (1, "Misc Aggregate 1", 110.0, 10.0),
        (2, "MISC AGGREGATE 2", 100.0, -100.0),
        (2, "ADMIX", 5.0, 1.0),
        (3, "MISC SAND 1", 0.0, 1.0),
        (4, "MISC AGGREGATE 3", 100.0, -150.0),
        (5, "MISC AGGREGATE 3", 102.0, 2.0),
    ]
    df = X.roll_up_batch(X.classify_batch_rows(frame(rows, "concreteTestId int, name string, weight double, moisture double")))
    out = {r["concreteTestId"]: r for r in df.collect()}
    assert set(out) == {1, 2, 4, 5}
    assert out[1]["SandMoisture_percent"] is None and out[1]["SandSSDWeight_lbs"] == 100.0
    assert out[1]["AggregateMoisture_percent"] == pytest.approx(10.0)
    assert out[2]["AggregateSSDWeight_lbs"] is None and out[2]["AggregateMoisture_percent"] is None
    assert out[5]["SandSSDWeight_lbs"] == 0.0 and out[5]["SandMoisture_percent"] is None


def test_round_even_and_percent(frame):
    df = frame([(0.125, 1, 800), (2.5, 57, 20000), (3.5, 1, 0)], "x double, a int, b int")
    assert column(df, E.round_even("x", 0)) == [0.0, 2.0, 4.0]
    assert column(df, E.percent2(F.col("a"), F.col("b"))) == [0.13, 0.29, None]


def test_bands(frame):
    df = frame([(2999.0,), (3000.0,), (6000.0,), (None,)], f"{S.TARGET} double")
    assert column(df, E.band(S.TARGET, C.STRENGTH_EDGES, C.STRENGTH_LABELS)) == ["< 3000 psi", "3000-3999 psi", ">= 6000 psi", None]
    assert column(df, E.band(S.TARGET, [0, 3000, 6000], ["a", "b"], right=True)) == ["a", "a", "b", None]


def test_deviation_and_failure(frame):
    df = frame([(1.0, 3.0), (5.0, 3.0), (None, 3.0)], "a double, lo double")
    assert column(df, E.below_amount("a", "lo")) == [2.0, 0.0, None]
    assert column(df, E.failure("a", "lo")) == [1, 0, None]


def test_clock_minutes_do_not_wrap(frame):
    df = frame([("23:50:00", "00:10:30"), ("bad", "00:10:00")], "a string, b string")
    assert column(df, E.clock_minutes("a", "b")) == [-1419.5, None]


def test_numeric_bucket_of_review_message(frame):
    df = frame(
        [("Acme", "1", "M", 4000.0, 1234.5, 7, 12.0, 2, 5.25)],
        "SupplierName string, plantNumber string, mixNumber string, RequiredStrength double, MeanMarginPsi double, TestCount int, P05MarginPsi double, FailureCount int, FailureRatePct double",
    )
    text = column(df, E.candidate_message(12))[0]
    assert text.startswith("Over the past 12 months, Acme Plant 1 Mix M averaged 1,234 psi above its 4,000-psi")
    assert "2 below-required result(s), a 5.2% rate" in text
    assert column(df, E.group_label()) == ["Acme | Plant 1 | Mix M | Req 4,000"]
