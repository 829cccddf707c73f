import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import detect, routing
from tidegauge.operators.adwin import AdaptiveWindow
from tidegauge.operators.ordering import Axis

AXIS = Axis(("series",))


def clipped(rnd, mean, sd):
    return min(1.0, max(0.0, rnd.gauss(mean, sd)))


def test_no_alarm_on_a_stationary_signal():
    rnd = random.Random(42)
    window = AdaptiveWindow(clock=16)
    assert not any(window.add(clipped(rnd, 0.03, 0.005)) for _ in range(300))


def test_alarm_soon_after_a_shift_and_the_window_shrinks():
    rnd = random.Random(42)
    window = AdaptiveWindow(clock=8)
    signal = [clipped(rnd, 0.05, 0.01) for _ in range(200)] + [clipped(rnd, 0.75, 0.02) for _ in range(150)]
    alarms = [i for i, x in enumerate(signal) if window.add(x)]
    assert alarms and 200 <= alarms[0] < 320
    # How many old values stay depends on where buckets end; on average it is about twenty.
    assert window.n <= 150 + 24 and abs(window.mean - 0.75) < 0.1


def test_histogram_keeps_exact_moments_while_nothing_is_cut():
    rnd = random.Random(0)
    xs = [rnd.random() for _ in range(500)]
    window = AdaptiveWindow(delta=1e-9)
    for x in xs:
        window.add(x)
    mean = sum(xs) / 500
    assert window.n == 500 and abs(window.mean - mean) < 1e-12
    assert abs(window.variance - sum((x - mean) ** 2 for x in xs) / 500) < 1e-12
    assert all(len(level) <= 5 for level in window.levels)
    with pytest.raises(ValueError):
        window.add(float("nan"))


def signals(spark):
    rnd = random.Random(11)
    rows = []
    for s in ("a", "b", "c"):
        n = {"a": 900, "b": 130, "c": 40}[s]
        rows += [(s, i, clipped(rnd, 0.2 if i < n // 2 else 0.8, 0.05)) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "series string, row_idx long, x double")


def test_fold_is_the_same_loop_for_any_segment_and_partitioning(spark):
    rows, df = signals(spark)
    want = {}
    for s in "abc":
        window = AdaptiveWindow(clock=8)
        for r in sorted(r for r in rows if r[0] == s):
            want[r[:2]] = (window.add(r[2]), window.n, window.alarms)
    assert any(hit for hit, _, _ in want.values())
    for segment, parts in ((1 << 16, 3), (64, 7), (128, 1)):
        out = detect.adwin(df.repartition(parts), AXIS, "x", clock=8, segment_rows=segment)
        assert {(r.series, r.row_idx): (r.drift_detected, r.width, r.n_alarms) for r in out.collect()} == want


def test_bins_count_every_row_and_find_the_shift(spark):
    rows, df = signals(spark)
    out = detect.adwin(df, AXIS, "x", clock=8, bin_rows=4).where("series = 'a'").orderBy("row_idx").collect()
    assert [r.row_idx for r in out] == list(range(3, 900, 4))
    hits = [r.row_idx for r in out if r.drift_detected]
    assert hits and 450 <= hits[0] < 520
    assert out[0].width == 4


def test_small_batches_do_not_change_the_fold(spark):
    _, df = signals(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    whole = sorted(map(tuple, detect.adwin(df, AXIS, "x", clock=8).collect()))
    spark.conf.set(key, "17")
    try:
        assert sorted(map(tuple, detect.adwin(df, AXIS, "x", clock=8).collect())) == whole
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("chunk", [4, 1000])
def test_persistence(spark, chunk):
    rnd = random.Random(2)
    alarms = [rnd.random() < 0.6 for _ in range(100)]
    df = spark.createDataFrame([("a", i, a) for i, a in enumerate(alarms)], "series string, row_idx long, alarm boolean")
    axis = Axis(("series",), chunk_rows=chunk)
    run = {r.row_idx: r.is_persistent for r in detect.persistence_consecutive(df, axis, "alarm", 3).collect()}
    win = {r.row_idx: r.is_persistent for r in detect.persistence_windowed(df, axis, "alarm", 4, 3).collect()}
    for i in range(100):
        assert run[i] == (i >= 2 and all(alarms[i - 2: i + 1]))
        assert win[i] == (sum(alarms[max(0, i - 3): i + 1]) >= 3)


def controller(values, initial, hybrid):
    action, out = initial, []
    for r in values:
        if action == "EDGE":
            action = "EDGE" if r >= 0.5 else "HYBRID" if hybrid and r >= 0.3 else "CLOUD"
        elif action == "HYBRID":
            action = "EDGE" if r >= 0.7 else "CLOUD" if r < 0.3 or not hybrid else "HYBRID"
        else:
            action = "EDGE" if r >= 0.7 else "CLOUD"
        out.append(action)
    return out


@pytest.mark.parametrize("initial", ["EDGE", "HYBRID", "CLOUD"])
@pytest.mark.parametrize("hybrid", [True, False])
def test_hysteresis_equals_the_state_machine(spark, initial, hybrid):
    rnd = random.Random(9)
    series = {f"s{k}": [rnd.choice([0.1, 0.29999, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9]) for _ in range(60)] for k in range(20)}
    df = spark.createDataFrame([(s, i, r) for s, v in series.items() for i, r in enumerate(v)], "series string, row_idx long, reliability double")
    out = routing.route_hysteresis(df, Axis(("series",), chunk_rows=8), initial=initial, hybrid=hybrid)
    got = {(r.series, r.row_idx): (r.action, r.previous_action, r.switch_count) for r in out.collect()}
    for s, values in series.items():
        before, switches = initial, 0
        for i, action in enumerate(controller(values, initial, hybrid)):
            switches += action != before
            assert got[s, i] == (action, before, switches)
            before = action


def test_error_ema_moves_only_when_a_label_arrives(spark):
    rnd = random.Random(4)
    loss = [rnd.random() if rnd.random() < 0.2 else None for _ in range(300)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(loss)], "series string, row_idx long, loss double")
    out = routing.error_ema(df, Axis(("series",), chunk_rows=4096), F.col("loss"), 0.8, 0.3)
    got = {r.row_idx: r.error_ema for r in out.collect()}
    state = 0.3
    for i, x in enumerate(loss):
        state = state if x is None else 0.8 * state + 0.2 * x
        assert abs(got[i] - state) < 1e-12


def test_closed_loop_is_the_same_in_segments(spark):
    rnd = random.Random(8)
    rows = [
        (p, i, rnd.random(), rnd.random(), 1.0, rnd.randrange(2), rnd.randrange(2), rnd.random(), rnd.randrange(2), p)
        for p in ("adaptive", "edge_only", "cloud_only") for i in range(120)
    ]
    cols = "series string, row_idx long, confidence double, drift double, quality double, edge_pred int, cloud_pred int, edge_conf double, label int, policy string"
    df = spark.createDataFrame(rows, cols)
    one = sorted(map(tuple, routing.closed_loop(df, AXIS).collect()))
    assert sorted(map(tuple, routing.closed_loop(df, AXIS, segment_rows=32, warm=10).collect())) == one
    assert {r[-3] for r in one if r[0] == "edge_only"} == {"EDGE"} and {r[-3] for r in one if r[0] == "cloud_only"} == {"CLOUD"}
    assert {r[-3] for r in one if r[0] == "adaptive"} == {"EDGE", "HYBRID", "CLOUD"}


def test_fixed_delay_error_equals_the_sparse_form(spark):
    rnd = random.Random(19)
    rows = [("a", i, float(rnd.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "series string, row_idx long, loss double")
    axis = Axis(("series",), chunk_rows=4096)
    late = axis.bounded(df, {"arrived": lambda w: F.lag("loss", 15).over(w)}, back=15)
    sparse = {r.row_idx: r.error_ema for r in routing.error_ema(late, axis, F.col("arrived"), 0.8, 0.1).collect()}
    fixed = {r.row_idx: r.error_ema for r in routing.delayed_error(df, {}, F.col("loss"), axis, 15, 0.8, 0.1).collect()}
    assert all(abs(sparse[i] - fixed[i]) < 1e-12 for i in range(400)) and fixed[14] == 0.1


def test_a_known_last_index_gives_the_same_rows(spark):
    _, df = signals(spark)
    one = sorted(map(tuple, detect.adwin(df, AXIS, "x", clock=8).collect()))
    assert sorted(map(tuple, detect.adwin(df, AXIS, "x", clock=8, segment_rows=256, last_index=899).collect())) == one
