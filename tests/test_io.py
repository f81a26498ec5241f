"""Sources, sinks and plan-time checks."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.operators import clean as C
from pourstat.operators import extract as X
from pourstat.operators import profile as P
from pourstat.sources import readers as R
from pourstat.sources import writers as W


def test_csv_keeps_text_and_encoding(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("plant,name\n002,caf\xe9\n".encode("latin-1"))
    row = R.read_csv(spark, str(path), encoding="ISO-8859-1").first()
    assert (row["plant"], row["name"]) == ("002", "café")


def test_csv_name_falls_back_to_parquet(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d.parquet"))
    assert R.read_table(spark, str(tmp_path / "d.csv")).count() == 3
    with pytest.raises(ValueError, match="unsupported"):
        R.read_table(spark, "x.xlsx")


def test_specimen_export(spark, tmp_path):
    path = tmp_path / "s.csv"
    header = ";".join(S.SPECIMEN_COLUMNS[:-1]) + "; calcCompressiveStrength "
    path.write_text(header + "\n" + ";".join(["1", '"a;b"', "28", "0"] + ["NULL"] * 9 + ["null", "", "2", "4100.5"]) + "\n")
    row = R.read_specimen_export(spark, str(path), sep=";").first()
    assert row["SpecimenRowId"] == "a;b" and row["castDate"] is None and row["ApplicableStrengthType"] is None
    assert row["calcCompressiveStrength"] == "4100.5"


def test_malformed_rows_are_rejected(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(",".join(S.SPECIMEN_COLUMNS) + "\n1,2\n")
    with pytest.raises(Exception):
        R.read_specimen_export(spark, str(path)).collect()


def test_column_checks(frame):
    df = frame([(None, 1)], "A string, b int")
    assert R.find_column(df, ["x", " a "]) == "A" and R.first_column(df, ["a", "b"]) == "b"
    assert R.first_filled_column(df, ["A", "b"]) == "b" and R.first_filled_column(df, ["z"]) is None
    with pytest.raises(ValueError, match="missing: c"):
        R.require_columns(df, ["b", "c"])
    assert R.clean_names(df.toDF("﻿A\r", " b ")).columns == ["A", "b"]
    with pytest.raises(ValueError, match="Plant"):
        R.resolve_context(frame([(1,)], "supplierId int"))


def test_sinks_round_trip(spark, tmp_path, frame):
    df = frame([(1, 'say "hi"', 2020), (2, None, 2021)], "i int, t string, y int")
    W.write_csv(df, str(tmp_path / "c"), quote_all=True)
    assert {r["t"] for r in R.read_csv(spark, str(tmp_path / "c")).collect()} >= {'say "hi"'}
    W.write_parquet(df, str(tmp_path / "p"), ["y"])
    assert spark.read.parquet(str(tmp_path / "p")).where("y = 2021").count() == 1
    W.write_run_record(df.agg(F.count("*").alias("rows")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["rows"] == 2
    kept = W.keep_as_view(df, "kept_rows")
    W.keep_as_view(df, "kept_rows")
    assert spark.table("kept_rows").count() == kept.count()


def test_model_round_trip(spark, tmp_path, frame):
    df = frame([(float(i), 2.0 * i) for i in range(10)], "x double, y double")
    lr = LinearRegression(labelCol="y")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), lr]).fit(df)
    W.save_model(model, str(tmp_path / "m"), ["x"], {"model_name": "LinearRegression", "test_r2": 1.0})
    loaded, meta = W.load_model(spark, str(tmp_path / "m"))
    assert meta["features"] == "x" and loaded.transform(df).first()["prediction"] == pytest.approx(0.0, abs=1e-6)
    assert W.model_parameters({"LinearRegression": lr}).where("Parameter = 'labelCol'").first()["Value"] == "y"


def test_best_model_under_a_fixed_name(spark, tmp_path, frame):
    df = frame([(float(i), 2.0 * i) for i in range(10)], "x double, y double")
    for k, reg in enumerate((0.0, 5.0)):
        model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y", regParam=reg)]).fit(df)
        W.save_model(model, str(tmp_path / f"Day0__M{k}"), ["x"], {"target": "y", "model_name": f"M{k}"})
    metrics = frame([("Day0", "M1", 5.0, 9.0), ("Day0", "M0", 5.0, 8.0)], "FeatureSet string, Model string, MAE double, RMSE double")
    assert W.keep_best_model(spark, str(tmp_path), metrics) == ("Day0", "M0")
    loaded, meta = W.load_model(spark, str(tmp_path / "best_holdout_model"))
    assert (meta["model_name"], meta["feature_set"], meta["features"], meta["target"]) == ("M0", "Day0", "x", "y")
    assert loaded.transform(df).first()["prediction"] == pytest.approx(0.0, abs=1e-6)
    with pytest.raises(ValueError, match="no model"):
        W.keep_best_model(spark, str(tmp_path), metrics.limit(0))


def test_collisions_and_drop_list(frame):
    with pytest.raises(ValueError, match="duplicate"):
        C.assert_no_collisions(frame([(1, 2)], "a int, A_x int"))
    with pytest.raises(ValueError, match="missing"):
        C.drop_listed(frame([(1,)], "a int"))
    assert C.drop_listed(frame([(1, 2)], "a int, b int"), ["b"]).columns == ["a"]


def test_feature_sets_never_leak(frame):
    for name in S.FEATURE_SETS:
        assert not set(S.FEATURE_SETS[name]) & set(S.LEAKAGE_COLUMNS)
    with pytest.raises(ValueError, match="leakage"):
        C.feature_columns(frame([(1,)], "a int"), "bad", {"bad": [S.FAILURE]})


def test_choose_needs_the_column(frame):
    df = frame([(" Acme ",), ("other",)], "s string")
    assert C.choose(df, "s", "ACME").count() == 1 and C.choose(df, "s", None).count() == 2
    with pytest.raises(ValueError, match="missing"):
        C.choose(df, "t", "x")


def test_unique_key_check(frame):
    with pytest.raises(ValueError, match="not unique"):
        P.assert_unique(frame([(1,), (1,)], "k int"), "k")


def test_hot_key_and_missing_key_duplicates(frame):
    df = frame([(1,)] * 50 + [(None,)] * 2 + [(2,)], "k int")
    out = {r["k"]: r["n"] for r in C.mark_duplicates(df, "k", "d").groupBy("k", "d").agg(F.count("*").alias("n")).where("d = 1").collect()}
    assert out == {1: 50, None: 2}


def test_extract_scans_prune_and_push_down(spark):
    from pourstat.workload import standins as V

    o = X.ExtractOptions("2001-06-30", office_id=2)
    df = X.scope_filter(X.join_entities(V.extract_tables(spark, "/root/testdata/sf0.001")), o).select("testId", "officeId")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "EqualTo(n_nationkey,2)" in plan


def test_csv_line_breaks_and_malformed_rows(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('a,b\n1,"two\nlines"\n3,x\n')
    assert [tuple(r) for r in R.read_csv(spark, str(path), multi_line=True).collect()] == [("1", "two\nlines"), ("3", "x")]
    path = tmp_path / "short.csv"
    path.write_text("a,b\n1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        R.read_csv(spark, str(path), strict=True).collect()
