"""Distributed ranks and quantiles against plain numpy on skewed groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pourstat.operators import order_stats as O


def skewed(seed: int, n: int = 900):
    """One group with most rows, repeated values, negatives, zero and missing values."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.7 else rnd.choice("abc")
        v = rnd.choice([None, 0.0, -3.5, 1e-9, 4000.25, rnd.uniform(-50, 50), rnd.uniform(3000, 5000), 1e12])
        rows.append((i, g, v))
    return rows + [(n, "single", 7.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy(frame, seed):
    rows = skewed(seed)
    probs = {"p0": 0.0, "p05": 0.05, "p5": 0.5, "p9": 0.9, "p1": 1.0}
    out = {r["g"]: r for r in O.exact_quantiles(frame(rows, "i long, g string, v double"), ["g"], "v", probs).collect()}
    for g in {r[1] for r in rows}:
        values = np.array([r[2] for r in rows if r[1] == g and r[2] is not None])
        for name, p in probs.items():
            assert out[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_global_quantile_without_keys(frame):
    df = frame([(float(i),) for i in range(11)], "v double")
    assert O.exact_quantiles(df, [], "v", {"q1": 0.25, "m": 0.5}).first().asDict() == {"q1": 2.5, "m": 5.0}


def test_percentile_order(frame):
    df = frame(skewed(3), "i long, g string, v double")
    for r in O.exact_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.95}).collect():
        assert r["a"] <= r["b"] <= r["c"] <= r["d"] <= r["e"]


def test_bucket_keeps_order(frame):
    values = [-1e300, -5.0, -1.0, -1e-300, 0.0, 5e-324, 1e-9, 0.999, 1.0, 1.0000001, 2.0, 1e12, 1e308]
    out = frame([(v,) for v in values], "v double").select("v", O.value_bucket("v").alias("b")).collect()
    buckets = [r["b"] for r in sorted(out, key=lambda r: r["v"])]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_match_window(frame, descending):
    rows = [(r[0], r[1], r[2], r[0] % 3) for r in skewed(4) if r[2] is not None]
    df = frame(rows, "i long, g string, v double, w int")
    got = {(r["g"], r["v"]): (r["s_upto"], r["s_total"]) for r in O.running_sums(df, ["g"], "v", {"s": F.col("w")}, descending).collect()}
    for g, v in got:
        inside = [w for _, h, x, w in rows if h == g and (x >= v if descending else x <= v)]
        assert got[(g, v)] == (sum(inside), sum(w for _, h, _, w in rows if h == g))


def test_percentile_rank_ties_and_single_row(frame):
    df = frame([(1, "a", 10.0), (2, "a", 20.0), (3, "a", 20.0), (4, "a", 30.0), (5, "b", 1.0)], "i int, g string, v double")
    out = {r["i"]: r["p"] for r in O.with_percentile_rank(df, ["g"], "v", "p").collect()}
    assert out == {1: 25.0, 2: 62.5, 3: 62.5, 4: 100.0, 5: 100.0}


def test_spread_row_number_equals_window(frame):
    rows = [(i, None if i % 7 == 0 else "g", i % 4, (i * 37) % 101) for i in range(200)]
    df = frame(rows, "i int, g string, a int, b int")
    spread = O.spread_row_number(df, ["g"], [("a", False)], [F.col("b"), F.col("i")], "n")
    w = Window.partitionBy("g").orderBy(F.desc("a"), "b", "i")
    plain = df.withColumn("n", F.row_number().over(w).cast("long"))
    assert sorted(map(str, spread.select("i", "n").collect())) == sorted(map(str, plain.select("i", "n").collect()))


@pytest.mark.parametrize("block", [3, 5, 1000])
def test_rolling_mean_across_blocks(frame, block):
    rows = [(i, "g" if i % 3 else "h", i // 4, float((i * 13) % 17)) for i in range(60)]
    df = frame(rows, "i int, g string, d int, v double")
    got = {r["i"]: r["m"] for r in O.rolling_mean(df, ["g"], "d", "i", "v", 3, "m", block).collect()}
    w = Window.partitionBy("g").orderBy("d", "i").rowsBetween(-2, 0)
    want = {r["i"]: r["m"] for r in df.withColumn("m", F.avg("v").over(w)).collect()}
    assert got == pytest.approx(want)


def test_top_rows_limits_before_the_exchange(frame):
    df = frame([(i, i % 2) for i in range(20)], "i int, g int")
    top = O.top_rows(df, ["g"], [F.desc("i")], 2)
    assert {r["i"] for r in top.collect()} == {19, 18, 17, 16}
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_nan_is_missing_and_infinities_are_outermost(frame):
    inf = float("inf")
    df = frame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert O.exact_quantiles(df, [], "v", {"m": 0.5, "top": 1.0}).first().asDict() == {"m": 2.0, "top": 3.0}
    df = frame([(inf,), (1.0,), (-inf,), (5.0,), (-1e300,)], "v double")
    got = O.exact_quantiles(df, [], "v", {"low": 0.0, "next": 0.25, "m": 0.5, "high": 1.0}).first().asDict()
    assert got == {"low": -inf, "next": -1e300, "m": 1.0, "high": inf}


@pytest.mark.parametrize("way", [O.exact_quantiles, O.selected_quantiles])
def test_both_quantile_ways_match_numpy(frame, way):
    rnd = random.Random(21)
    pool = [1e9, 1e9 + 0.5, 1e9 + 1, -2.0, 0.0, 0.25, 3.0, float("inf"), None, float("nan")]
    data = [(k, rnd.choice(pool)) for k in "abc" for _ in range(rnd.randrange(1, 90))] + [("one", 4.0), ("none", None)]
    probs = {"low": 0.0, "q1": 0.25, "m": 0.5, "p9": 0.9, "high": 1.0}
    got = {r.k: r for r in way(frame(data, "k string, v double"), ["k"], "v", probs).collect()}
    for k in {k for k, _ in data}:
        values = [v for a, v in data if a == k and v is not None and not math.isnan(v)]
        assert (k in got) == bool(values)
        for name, p in probs.items():
            if values:
                below, above = sorted(values)[math.floor(p * (len(values) - 1))], sorted(values)[math.ceil(p * (len(values) - 1))]
                want = below if below == above else below + (above - below) * (p * (len(values) - 1) % 1)
                assert got[k][name] == pytest.approx(want)
    whole = way(frame(data, "k string, v double"), [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1
