"""Segments that run at once give what the plain loop gives, whatever they assumed."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from tidegauge.operators import detect, routing
from tidegauge.operators.adwin import AdaptiveWindow
from tidegauge.operators.ordering import Axis
from tidegauge.operators.speculative import speculative_fold

AXIS = Axis(("series",))


def test_a_window_is_carried_over_a_segment_with_the_same_bits():
    r, agreed, cuts = random.Random(1), 0, 0
    for _ in range(120):
        size, segments, clock, most = r.choice([64, 128, 256]), r.randrange(2, 6), r.choice([1, 4, 8, 10, 32, 100]), r.randrange(2, 8)
        jumps, mean, xs = r.choice([0, 0.002, 0.02]), 0.2, []
        for _ in range(size * segments):
            mean = r.random() if r.random() < jumps else mean
            xs.append(mean + r.gauss(0, 0.05))
        ws = [r.choice([1, 1, 3]) for _ in xs]
        ss = [r.random() * 0.01 if w > 1 else 0.0 for w in ws]
        window = AdaptiveWindow(clock=clock, max_buckets=most)
        for k in range(segments):
            part = slice(k * size, (k + 1) * size)
            tree = window.summary(np.array(xs[part]), np.array(ws[part]), np.array(ss[part]), k * size)
            guess = window.thawed(window.frozen()).advanced(tree, size).frozen()
            hits = sum([window.add(*x) for x in zip(xs[part], ws[part], ss[part])])
            assert window.thawed(window.frozen()).frozen() == window.frozen()
            assert hits or guess == window.frozen()
            assert all(len(level) <= most for level in window.levels)
            agreed, cuts = agreed + (not hits), cuts + bool(hits)
    assert agreed > 50 and cuts > 50


def series_of(kind, n, r):
    if kind == "stationary":
        return [r.gauss(0.3, 0.02) for _ in range(n)]
    if kind == "one shift":
        return [r.gauss(0.2 if i < n // 3 else 0.8, 0.03) for i in range(n)]
    if kind == "constant":
        return [0.5] * n
    # Adversarial: the mean jumps all the time, so that every segment cuts.
    return [(i // 37 % 2) * 0.9 + r.gauss(0, 0.01) for i in range(n)]


def test_detector_equals_the_plain_loop_and_reports_what_ran_again(spark):
    r = random.Random(3)
    reports = {}
    for kind in ("stationary", "one shift", "constant", "adversarial"):
        xs = {kind: series_of(kind, 1500, r), "short": series_of(kind, 40, r), "whole": series_of(kind, 640, r)}
        rows = [(s, i, x) for s, v in xs.items() for i, x in enumerate(v)]
        r.shuffle(rows)
        out = detect.adwin_folded(spark.createDataFrame(rows, "series string, row_idx long, x double"), AXIS, "x", clock=8, segment_rows=64)
        want = []
        for s, values in xs.items():
            window = AdaptiveWindow(clock=8)
            want += [(s, i, x, window.add(x), window.mean, window.variance, window.n, window.total, window.alarms) for i, x in enumerate(values)]
        assert sorted(map(tuple, out.rows.collect())) == sorted(want)
        reports[kind] = out
    assert all(o.segments == 24 + 1 + 10 for o in reports.values())
    assert reports["stationary"].again == reports["constant"].again == 0 and reports["stationary"].rounds == 1
    assert 0 < reports["one shift"].again < 2 * reports["one shift"].segments and reports["one shift"].rounds <= 5
    # Every segment cuts: each has to run again once it is its turn, and little more than that.
    assert reports["adversarial"].again <= 24 * 24 // 2


def test_bins_in_segments(spark):
    r = random.Random(5)
    rows = [("a", i, x) for i, x in enumerate(series_of("one shift", 1100, r))]
    df = spark.createDataFrame(rows, "series string, row_idx long, x double")
    whole = sorted(map(tuple, detect.adwin(df, AXIS, "x", clock=8, bin_rows=4).collect()))
    assert sorted(map(tuple, detect.adwin(df, AXIS, "x", clock=8, bin_rows=4, segment_rows=64).collect())) == whole


class Remembering:
    """Counts values; remembers the largest so far: a state that never forgets."""

    outputs = T.StructType([T.StructField("n", T.LongType()), T.StructField("top", T.DoubleType())])

    def __init__(self, warm):
        self.warm = warm

    def start(self):
        return 0, 0.0

    def step(self, state, part):
        n, top = state
        out = []
        for x in part["x"].tolist():
            n, top = n + 1, max(top, x)
            out.append((n, top))
        return (n, top), pd.DataFrame(out, columns=["n", "top"])

    def frozen(self, state):
        return np.array(state, dtype="<f8").tobytes()

    def thawed(self, data):
        n, top = np.frombuffer(data, dtype="<f8").tolist()
        return int(n), top


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_a_state_that_never_forgets_runs_segment_after_segment(spark, batch):
    r = random.Random(6)
    rows = [(s, i, r.random()) for s, n in (("a", 95), ("b", 20), ("c", 41), ("d", 1)) for i in range(n)]
    spark.sparkContext.addPyFile(__file__)  # workers need the machine above
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        out = speculative_fold(spark.createDataFrame(rows, "series string, row_idx long, x double"), AXIS, Remembering(5), 20)
        got = {(x.series, x.row_idx): (x.n, x.top) for x in out.rows.collect()}
    finally:
        spark.conf.set(key, before)
    top: Counter = Counter()
    for s, i, x in rows:
        top[s] = max(top[s], x)
        assert got[s, i] == (i + 1, top[s])
    assert len(got) == len(rows) and (out.segments, out.rounds, out.again) == (10, 5, 6)


def test_a_held_action_is_found_out_and_run_again(spark):
    # Reliability stays where the controller keeps what it has: a warm-up can't know the action.
    r = random.Random(7)
    n = 700
    level = lambda i: 0.02 if i == 50 else 0.62
    rows = [("adaptive", i, level(i), 0.0, 1.0, 1, 1, r.random(), r.randrange(2) if i % 9 == 0 else 1, "adaptive") for i in range(n)]
    rows += [("edge_only", i, level(i), 0.0, 1.0, i % 2, 1, r.random(), None if i % 50 == 0 else 1, "edge_only") for i in range(n)]
    df = spark.createDataFrame(rows, "series string, row_idx long, confidence double, drift double, quality double, edge_pred int, cloud_pred int, edge_conf double, label int, policy string")
    whole = routing.closed_loop(df, AXIS).collect()
    cut = routing.closed_loop(df, AXIS, segment_rows=128, warm=100).collect()
    moving = lambda some: sorted(map(repr, (x for x in map(tuple, some) if x[0] == "adaptive")))
    assert moving(cut) == moving(whole)
    error, waiting = 0.0, []
    for x in sorted((x for x in whole if x.series == "edge_only"), key=lambda x: x.row_idx):
        if len(waiting) == 15:
            error = 0.8 * error + 0.2 * waiting.pop(0)
        assert abs(x.error_ema - error) < 1e-12 and x.action == "EDGE" and x.prediction == x.edge_pred
        waiting.append(float(x.edge_pred != x.label))


def test_refused_sizes(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "series string, row_idx long, x double")
    with pytest.raises(ValueError, match="power of two"):
        detect.adwin(df, AXIS, "x", segment_rows=100)
    with pytest.raises(ValueError, match="at least 64"):
        detect.adwin(df, AXIS, "x", segment_rows=32)
    with pytest.raises(ValueError, match="warm-up"):
        speculative_fold(df, AXIS, Remembering(50), 20)
    assert detect.adwin(df.limit(0), AXIS, "x").collect() == []
