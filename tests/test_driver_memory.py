"""What grows with the stream is joined where it lies, and pairs to judge are dealt by their number."""

import random

import pytest

from pyspark.sql import functions as F

from tidegauge.operators import feedback
from tidegauge.operators.ordering import Axis
from tidegauge.plans import adapt, evaluation
from tidegauge.session import materialise

AXIS = Axis(("seed", "series_id"))


def rows(spark, n, seed=1):
    r = random.Random(seed)
    data = [(s, d, i, r.gauss(0, 1), r.gauss(0, 1) + d, int(r.random() < 0.4)) for s in (0, 1) for d in (0, 1) for i in range(n)]
    return materialise(spark.createDataFrame(data, "seed int, series_id long, row_idx long, z_value double, z_k double, y int"), "rows")


def attempts(spark):
    data = [(s, d, k, t) for s in (0, 1) for d in (0, 1) for k, t in enumerate([60, 130, 200, 260, 333, 400, 480])]
    return materialise(spark.createDataFrame(data, "seed int, series_id long, attempt long, trigger_idx long"), "attempts")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def gathered(text, column):
    """Joins on this column that are planned by gathering one side on the driver."""
    return [line for line in text.splitlines() if "BroadcastHashJoin" in line and f"{column}#" in line.split("], [")[0]]


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that are written, by name."""
    plans = {}

    def keep(df, tag):
        plans[tag] = plan(df)
        return materialise(df, tag)

    for module in (adapt, evaluation):
        monkeypatch.setattr(module, "materialise", keep)
    return plans


def test_attempts_meet_their_device_and_each_other_without_the_driver(spark, written):
    tried, late, own = attempts(spark), rows(spark, 600), rows(spark, 30, seed=2).where("seed = 0").drop("seed")
    assert "BroadcastHashJoin" not in plan(adapt.candidates(tried, late, own, AXIS))
    first = materialise(own.groupBy("series_id").agg(F.lit(0.1).alias("first_metric")), "first")
    audit = adapt.audited(tried, late, own, own, first, AXIS)
    assert audit.count() == 28 and audit.where("accepted").count() > 0
    assert not gathered(written["scores"], "attempt") and not gathered(written["cycles"], "attempt")
    held = adapt.in_force(late, audit, AXIS)
    assert not gathered(written["placed"], "row_idx")
    since = {(r.seed, r.series_id): r.at for r in audit.where("accepted").groupBy("seed", "series_id").agg(F.min("trigger_idx").alias("at")).collect()}
    assert all((r.model is not None) == (r.row_idx > since.get((r.seed, r.series_id), 600)) for r in held.collect())


def test_scores_are_judged_once_for_the_gate(spark, written, monkeypatch):
    seen = []
    monkeypatch.setattr(feedback, "gate_sequence", lambda table, *rest, own=feedback.gate_sequence: seen.append(plan(table)) or own(table, *rest))
    own = rows(spark, 30, seed=2).where("seed = 0").drop("seed")
    first = materialise(own.groupBy("series_id").agg(F.lit(0.1).alias("first_metric")), "first")
    adapt.audited(attempts(spark), rows(spark, 600), own, own, first, AXIS)
    assert len(seen) == 1 and "MapInPandas" not in seen[0]


def test_pairs_are_dealt_by_their_number_whatever_they_hold(spark, monkeypatch):
    for name, n in (("JUDGED_ATTEMPTS", 1), ("JUDGED_ROWS", 10), ("JUDGED_PAIRS", 2)):
        monkeypatch.setattr(adapt, name, n)
    own = rows(spark, 100, seed=2).where("seed = 0").drop("seed")
    wide = adapt.wide_models(adapt.candidates(attempts(spark), rows(spark, 600), own, AXIS), AXIS)
    judged = adapt.judged(wide, own, AXIS)
    # 2 seeds x 7 attempts x 10 blocks of rows x 2 devices, two pairs a task.
    assert plan(judged).count("140), REPARTITION_BY_NUM") == 2
    assert {r.n for r in judged.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n")).collect()} == {100}


def test_triggers_meet_their_rows_without_the_driver(spark):
    ready = rows(spark, 200).select(*AXIS.series, "row_idx", F.lit(True).alias("is_persistent"), F.lit(0.5).alias("smoothed_severity"), F.col("row_idx").alias("n_eligible"))
    fired = feedback.adaptation_triggers(materialise(ready, "ready"), AXIS, cooldown=50)
    assert not gathered(plan(fired), "row_idx")
    assert sorted(r.row_idx for r in fired.where("fired and seed = 0 and series_id = 1").collect()) == [25, 75, 125, 175]


def test_alarms_meet_their_rows_without_the_driver(spark, written, monkeypatch):
    data = [("ADAPTIVE", 42, 1, i, float(i >= 150)) for i in range(300)]
    replayed = materialise(spark.createDataFrame(data, "method string, seed int, series_id long, row_idx long, signal double"), "runs")
    monkeypatch.setattr(evaluation.R, "replayed", lambda *_: replayed)
    monkeypatch.setattr(evaluation.E, "staged", lambda spark, sf_dir, name, build: build())
    assert evaluation.detected(spark, "").where("drift_detected").count() > 0
    assert not gathered(written["detected"], "row_idx")
