"""Checks that have to fail, and cohorts with repeated keys."""

import pytest
from pyspark.sql import functions as F

from pourstat.operators import clean as C
from pourstat.operators import decide as D
from pourstat.operators import splits as L
from pourstat.workload.standins import view

SF = "/root/testdata/sf0.001"


def test_recipe_cohort_has_one_row_per_test(spark):
    facts = view(spark, SF, "facts")
    once, twice = C.recipe_cohort(facts), C.recipe_cohort(facts.union(facts))
    assert twice.count() == once.count() == once.select("testId").distinct().count() > 0
    changed = facts.union(facts.withColumn("EffectiveSlump_in", F.lit(1.0)))
    assert C.recipe_cohort(changed).count() == once.count()


def test_one_to_one_merge_refuses_repeated_keys(frame):
    one, two = frame([(1, 2), (2, 3)], "k int, a int"), frame([(1, 5), (1, 6)], "k int, b int")
    assert D.merge_one_to_one(one, two.limit(1), ["k"]).count() == 1
    with pytest.raises(ValueError, match="not unique"):
        D.merge_one_to_one(one, two, ["k"])


def test_many_to_one_merge_refuses_unmatched_rows(frame):
    rows, side = frame([(1,), (2,)], "k int"), frame([(1, 5)], "k int, r int")
    with pytest.raises(Exception, match="no r for a row"):
        D.merge_many_to_one(rows, side, ["k"], "r").collect()


def test_models_present(frame):
    best = frame([("A", "M1"), ("B", "M2")], "FeatureSet string, Model string")
    rows = frame([("A", "M1", 1), ("B", "M1", 1)], "FeatureSet string, Model string, testId int")
    with pytest.raises(ValueError, match="no predictions"):
        D.assert_models_present(rows, best)
    D.assert_models_present(rows, best.where("FeatureSet = 'A'"))


def test_disjoint_sides(frame):
    one, two = frame([(1,), (2,)], "testId int"), frame([(2,)], "testId int")
    L.assert_disjoint(one, two.where("testId > 2"), "testId")
    with pytest.raises(ValueError, match="both sides"):
        L.assert_disjoint(one, two, "testId")


def test_unseen_categories_use_the_whole_training_side(frame):
    from pourstat.workload.model_queries import unseen_categories

    rows = [(50, "train", "a"), (7, "train", "b"), (8, "test", "a"), (9, "test", "b"), (9, "test", "c"), (10, "test", "c")]
    found = unseen_categories(frame(rows, "projectId int, DatasetSplit string, SupplierPlantMixCategory string"))
    assert [r[0] for r in found.collect()] == ["c"]


def test_narrow_extract_equals_the_whole_one_filtered(spark):
    from pourstat.operators import extract as X
    from pourstat.workload.standins import extract_tables

    t = extract_tables(spark, "/root/testdata/sf0.001")
    whole = X.build_extract(t, X.ExtractOptions("2001-06-30", first_valid_day="1995-02-01"))
    narrow = X.build_extract(t, X.ExtractOptions("2001-06-30", first_valid_day="1995-02-01", office_id=3))
    expected = whole.where("officeId = 3")
    assert expected.count() == narrow.count() > 0
    assert expected.exceptAll(narrow).count() == 0 and narrow.columns == whole.columns
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 3


def test_suspicious_flags_without_some_columns(spark):
    facts = view(spark, SF, "facts")
    lost = ["EffectiveSpread_in", "LoadBatchVolumeRaw", "BatchToCastMinutes"]
    whole, part = C.suspicious_flags(facts), C.suspicious_flags(facts.drop(*lost))
    assert not set(lost) & set(part.columns)
    same = [n for n in C.SUSPICIOUS_FLAGS if n not in ("NegativeSpread", "NonPositiveLoadBatchVolume", "BatchToCastOver24Hours")]
    assert sorted(map(tuple, whole.select("testId", *same).collect())) == sorted(map(tuple, part.select("testId", *same).collect()))
    gone = part.agg(*[F.sum(n).alias(n) for n in C.SUSPICIOUS_FLAGS if n not in same]).first()
    assert set(gone) == {0}
