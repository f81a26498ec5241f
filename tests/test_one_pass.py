"""Steps that read their input once or keep little of it: results on odd rows, and what the plans hold."""

import re

import pytest
from pyspark.sql import functions as F

from pourstat import schema as S
from pourstat.operators import clean as C
from pourstat.operators import extract as X
from pourstat.operators import mixes as H
from pourstat.operators import models as L


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def history(spark, reads=None):
    """Forty tests of two projects, one test twice, as rows that are counted whenever they are worked out."""
    names = H.evaluation_columns()
    rows = []
    for i in [*range(40), 7]:
        known = {"testId": i, "officeId": i % 2, "projectId": i % 2, "SupplierName": f"s{i % 3}", "plantNumber": "p", "mixNumber": f"m{i % 2}"}
        known |= {S.REQUIRED: 3000.0 + 0.1 * (i % 3), S.TARGET: 2900.1 + 37.3 * (i % 11)}
        rows.append(tuple(known.get(c, 1.5) for c in names))
    kinds = ["string" if c.endswith(("Name", "Number")) else "long" if c in ("testId", "officeId", "projectId") else "double" for c in names]

    def seen(row):
        if reads is not None:
            reads.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))


def test_history_audit_works_its_input_out_once(spark):
    reads = spark.sparkContext.accumulator(0)
    audit = {r["metric"]: r["value"] for r in H.history_audit(history(spark, reads), min_project=5, min_group=2).collect()}
    assert audit["input_rows"] == 41 and audit["eligible_unique_test_rows"] == 40 and audit["rows_in_eligible_projects"] == 40
    assert reads.value == 41


def test_distinct_names_are_counted_on_combinations(spark):
    rows = H.evaluation_rows(history(spark))
    summary = H.project_summary(rows, 5)
    found = {r["projectId"]: (r["ProjectTestCount"], r["SupplierCount"], r["PlantCount"], r["MixCount"], r["EligibleProject"]) for r in summary.collect()}
    assert found == {0: (20, 3, 1, 1, True), 1: (20, 3, 1, 1, True)}
    assert "testId" not in "".join(re.findall(r"Expand.*", plan(summary)))


def test_margins_share_the_ranks_of_strengths(spark):
    rows = H.evaluation_rows(history(spark))
    groups = H.mix_groups(rows)
    assert "unpivot" not in plan(groups, "analyzed").lower() and "Expand" not in plan(groups)
    wanted = {
        tuple(r[c] for c in H.GROUP): (r["n"], r["p50"], r["p10"])
        for r in rows.groupBy(*H.GROUP).agg(F.count("testId").alias("n"), F.percentile("StrengthMargin_psi", 0.5).alias("p50"), F.percentile("StrengthMargin_psi", 0.1).alias("p10")).collect()
    }
    for r in groups.collect():
        n, p50, p10 = wanted.pop(tuple(r[c] for c in H.GROUP))
        assert r["TestCount"] == n and r["MedianSpecMargin_psi"] == pytest.approx(p50) and r["P10SpecMargin_psi"] == pytest.approx(p10)
    assert not wanted


def test_wide_concrete_tests_take_part_in_one_join(frame):
    t = {
        "offices": frame([(1, "north")], "officeId int, name string"),
        "projects": frame([(5, "P-5", 1), (6, "P-6", None)], "projectId int, projectNo string, officeId int"),
        "samples": frame([(10, "L10", 5), (11, "L11", 6), (None, "L", 5)], "id int, labNo string, projectId int"),
        "tests": frame([(100, 10), (100, 10), (101, 11), (102, None)], "testId int, sampleId int"),
        "concrete_tests": frame([(1, 100, "a"), (1, 100, "b"), (None, 100, "c"), (2, 101, "d"), (3, 102, "e"), (4, None, "f")], "id int, testbaseId int, wide string"),
    }
    df = X.join_entities(t)
    assert df.columns == ["officeId", "projectId", "SampleId", "testId", "ConcreteTestDataId", "wide", "labNo", "projectNo", "OfficeName"]
    assert sorted(r["wide"] for r in df.collect()) == ["a", "a", "b", "b", "c", "c"]
    lines = plan(df).splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = max(i for i, line in enumerate(lines) if "wide#" in line)
    above, joins = depth[at], 0
    for i in range(at, -1, -1):
        if depth[i] < above:
            above = depth[i]
            joins += "Join" in lines[i]
    assert joins == 1


def test_specimens_are_not_buffered_in_an_aggregate(frame):
    rows = [(1, "a", 10.0, 28), (1, "a", 12.0, 28), (1, "b", 14.0, 27), (1, None, 20.0, None), (2, None, 5.0, 28), (None, "z", 1.0, 1), (None, "z", 3.0, 1)]
    out = C.strength_target(frame(rows, "testId int, SpecimenRowId string, calcCompressiveStrength double, ActualAgeDays int"))
    found = {r["testId"]: (r["StandardCuredSpecimenCount28"], r["UniqueStandardCuredSpecimenCount28"], r["AverageActualStrength28_psi"]) for r in out.collect()}
    assert found == {1: (4, 2, 14.0), 2: (1, 0, 5.0), None: (2, 1, 2.0)}
    assert not re.search(r"Aggregate\(keys=\[[^\]]*SpecimenRowId", plan(out, "sparkPlan"))


def test_test_rows_are_read_once_for_all_models(frame):
    rows = [(i, "test" if i % 4 == 0 else "train", float(i % 7), float(i % 5), 3000.0 + 10 * (i % 7)) for i in range(80)]
    df = frame(rows, "testId int, Role string, x double, z double, y double")
    specs = {n: s for n, s in L.regressors(L.Size(trees=2, rounds=2, depth=2)).items() if n in ("DummyMean", "Ridge", "RandomForest")}
    out = L.evaluate_split(df, {"f": ["x", "z"]}, specs, "y", ["testId"])
    assert out.columns == ["testId", "FeatureSet", "Model", "ActualStrength28_psi", "PredictedStrength28_psi"]
    assert out.count() == 60 and out.groupBy("testId").count().where("count != 3").isEmpty()
    assert "Union" not in plan(out)
