"""Candidates of retrainings: what they learn from and how they are judged, laid out in blocks."""

import math
import random

from pyspark.sql import functions as F

from tidegauge.operators import metrics
from tidegauge.operators.ordering import Axis
from tidegauge.plans import adapt

AXIS = Axis(("seed", "series_id"))


def rows(spark, n, seed=1):
    r = random.Random(seed)
    data = [(s, d, i, r.gauss(0, 1), r.gauss(0, 1) + d, int(r.random() < 0.4)) for s in (0, 1) for d in (0, 1) for i in range(n)]
    return spark.createDataFrame(data, "seed int, series_id long, row_idx long, z_value double, z_k double, y int")


def attempts(spark, triggers):
    data = [(s, d, k, t) for s in (0, 1) for d in (0, 1) for k, t in enumerate(triggers)]
    return spark.createDataFrame(data, "seed int, series_id long, attempt long, trigger_idx long")


def test_candidates_learn_from_the_newest_labels_and_nothing_is_gathered(spark):
    late, own, tried = rows(spark, 600), rows(spark, 30, seed=2).where("seed = 0").drop("seed"), attempts(spark, [40, 143, 255, 400, 614])
    stats = adapt.candidates(tried, late, own, AXIS)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "__span" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "__span" in line]
    got = {(r.seed, r.series_id, r.attempt, r.label): (r.n, round(r.z_k__sum, 9), round(r.z_value__sq, 9)) for r in stats.collect()}
    known, base = [tuple(r) for r in late.collect()], [tuple(r) for r in own.collect()]
    for t in tried.collect():
        to = t.trigger_idx - adapt.DELAY
        for label in (0, 1):
            mine = [(x[3], x[4]) for x in known if x[:2] == (t.seed, t.series_id) and to - adapt.NEWEST < x[2] <= to and x[5] == label]
            mine += [(x[2], x[3]) for x in base if x[0] == t.series_id and x[4] == label]
            assert got[t.seed, t.series_id, t.attempt, label] == (len(mine), round(sum(k for _, k in mine), 9), round(sum(v * v for v, _ in mine), 9))


def test_judged_in_blocks_counts_what_the_posterior_says(spark, monkeypatch):
    monkeypatch.setattr(adapt, "JUDGED_ATTEMPTS", 3)
    monkeypatch.setattr(adapt, "JUDGED_ROWS", 50)
    monkeypatch.setattr(adapt, "HELD", 2)
    wide = adapt.wide_models(adapt.candidates(attempts(spark, [60, 130, 200, 260, 333, 400, 480]), rows(spark, 600), rows(spark, 30, seed=2).drop("seed"), AXIS), AXIS)
    # A class without rows, one without spread, classes that are alike.
    odd = F.when(F.col("attempt") == 1, F.lit(None))
    wide = wide.withColumn("n__1", F.coalesce(F.when(F.col("attempt") != 1, F.col("n__1")), odd.cast("long")))
    alike = {f"{c[:-1]}1": F.when(F.col("attempt") == 4, F.col(f"{c[:-1]}0")).otherwise(F.col(f"{c[:-1]}1")) for c in adapt.MODEL if c.endswith("1")}
    wide = wide.withColumns(alike).withColumn("z_k__sq__0", F.when(F.col("attempt") == 2, F.col("z_k__sum__0") ** 2 / F.col("n__0")).otherwise(F.col("z_k__sq__0")))
    r = random.Random(3)
    strange = [(0.0, 0.0, 1), (None, 1.0, 1), (1.0, 1.0, None), (math.nan, 0.5, 0), (math.inf, 0.5, 1), (-math.inf, math.inf, 0), (1e9, 1.0, 0)]
    data = [(d, i, *x) for d in (0, 1) for i, x in enumerate([*strange, *[(r.gauss(0, 2), r.gauss(1, 2), r.randrange(2)) for _ in range(170)]])]
    val = spark.createDataFrame([*data, (7, 0, 1.0, 1.0, 1)], "series_id long, row_idx long, z_value double, z_k double, y int")
    every = val.drop("row_idx").join(wide, "series_id").withColumn("prediction", (adapt.posterior() >= 0.5).cast("int"))
    want = {tuple(r) for r in metrics.classification_metrics(every, "y", "prediction", ["seed", "series_id", "attempt"]).collect()}
    got = {tuple(r) for r in metrics.scored_counts(adapt.judged(wide, val, AXIS), ["seed", "series_id", "attempt"]).collect()}
    assert got == want and len(got) == 28
