import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import profile, quality
from tidegauge.operators.ordering import Axis


@pytest.mark.parametrize("n,accuracy", [(1, 10000), (2, 10000), (3, 10000), (7, 50), (856, 10000), (5000, 40)])
def test_exact_quantiles(spark, n, accuracy):
    rnd = random.Random(n)
    rows = [("a", rnd.choice([1.0, 2.0, rnd.gauss(0, 3)]), rnd.random()) for _ in range(n)]
    rows += [("b", None, rnd.random()) for _ in range(3)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = {(r["g"], r["column"]): [r[f"q{i}"] for i in range(6)] for r in profile.exact_quantiles(df, ["x", "y"], probs, ["g"], accuracy).collect()}
    assert ("b", "x") not in got
    for j, c in ((1, "x"), (2, "y")):
        want = np.quantile([r[j] for r in rows if r[0] == "a"], probs)
        assert np.allclose(got["a", c], want, atol=1e-12)


def test_frozen_statistics_match_a_recomputation(spark):
    rnd = random.Random(1)
    xs = [rnd.gauss(2, 3) for _ in range(999)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    row = profile.fit_statistics(df, ["x"]).first()
    assert row.n_rows == 999
    assert abs(row["mean"] - statistics.fmean(xs)) < 1e-12 and abs(row["std"] - statistics.pstdev(xs)) < 1e-12
    assert np.allclose([row.q1, row.q3], np.quantile(xs, [0.25, 0.75]))
    wide = profile.apply_frozen(df, profile.wide_statistics(profile.fit_statistics(df, ["x"]), ["x"]))
    z = wide.select(quality.normalize_frozen("x").alias("z")).agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    assert abs(z.m) < 1e-12 and abs(z.s - 1) < 1e-12


@pytest.mark.parametrize("chunk", [5, 1000])
def test_forward_fill_limit_and_blocks(spark, chunk):
    rnd = random.Random(5)
    xs = [rnd.random() if rnd.random() < 0.3 else None for _ in range(200)]
    block = [i // 37 for i in range(200)]
    df = spark.createDataFrame([("a", i, b, x) for i, (b, x) in enumerate(zip(block, xs))], "series string, row_idx long, block_id long, x double")
    out = quality.forward_fill(df, Axis(("series",), chunk_rows=chunk), ["x"], 3)
    got = {r.row_idx: (r.x, r.filled, r.unfilled) for r in out.collect()}
    last, age = None, 0
    for i, x in enumerate(xs):
        if i and block[i] != block[i - 1]:
            last = None
        last, age = (x, 0) if x is not None else (last, age + 1)
        value = last if age <= 3 else None
        assert got[i] == (value, x is None and value is not None, value is None)


def test_null_is_no_violation_and_stays_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (99.0,)], "x double").crossJoin(
        spark.createDataFrame([(0.0, 1.0, -1.0, 1.0, -0.5, 0.5)], "x__mean double, x__std double, x__minimum double, x__maximum double, x__q1 double, x__q3 double")
    )
    assert [r.range_violation for r in quality.range_check(df, ["x"]).collect()] == [False, False, True]
    assert [r.x for r in quality.outlier_clip(df, ["x"]).collect()] == [1.0, None, 3.5]


def test_refusals(spark):
    p = profile.profile_columns(spark.createDataFrame([(i, i % 2) for i in range(50)], "wide int, flag int"), ["wide", "flag"])
    assert profile.resolve_target(p, "flag", "classification") == "flag"
    for target, task in (("wide", "classification"), ("flag", "regression"), ("none", "regression"), (None, "classification")):
        with pytest.raises(ValueError):
            profile.resolve_target(p, target, task)
    with pytest.raises(ValueError):
        profile.classify_columns(p, continuous=["flag"], discrete=["flag"])
    with pytest.raises(ValueError):
        quality.outlier_bounds("x", "domain")


def test_sketched_profile_agrees_on_kind_and_moments(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("few"), (F.col("id") * 1.5).alias("many"), F.lit(3).alias("one"))
    exact = {r["column"]: r for r in profile.profile_columns(df, df.columns).collect()}
    rough = {r["column"]: r for r in profile.profile_columns(df, df.columns, exact=False).collect()}
    for c in df.columns:
        assert (rough[c].is_discrete, rough[c].zero_variance, rough[c]["mean"], rough[c].maximum) == (
            exact[c].is_discrete, exact[c].zero_variance, exact[c]["mean"], exact[c].maximum
        )
    assert rough["few"].n_unique == 7 and abs(rough["many"].n_unique - 5000) < 200


def test_large_groups_are_not_sorted_for_their_quantiles(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    plans = {}
    for marks in (0, 1000):
        out = profile.exact_quantiles(df, ["x"], [0.5], ["g"], 1000, broadcast_marks=marks)
        plans[marks] = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == [(0, "x", 1499.0), (1, "x", 1500.0)]
    assert "BroadcastHashJoin" in plans[1000] and "SortMergeJoin" not in plans[1000]
