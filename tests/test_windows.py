import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import windows
from tidegauge.operators.ordering import Axis

AXIS = Axis(("series",), chunk_rows=16)


def index_stream(spark, n=100, blocks=lambda i: 0, valid=lambda i: True):
    return spark.createDataFrame(
        [("a", i, i, blocks(i), valid(i), float(i)) for i in range(n)],
        "series string, row_idx long, sec long, block_id long, valid boolean, x double",
    ).withColumn("ts", F.timestamp_seconds("sec"))


def emitted(spark, df, size, step, **kw):
    w = windows.sliding_windows(df, AXIS, size, step, continuous=["x"], ts="ts", block="block_id", valid="valid")
    return sorted(windows.emit(w, AXIS, step, **kw).collect(), key=lambda r: r.start_index), w


def test_membership_and_ids(spark):
    got, _ = emitted(spark, index_stream(spark), 10, 5)
    assert [(r.window_id, r.start_index) for r in got] == [(i, 5 * i) for i in range(19)]
    assert all((r["x__min"], r["x__max"], r["x__last"]) == (r.start_index, r.end_index - 1, r.end_index - 1) for r in got)


def test_no_window_spans_a_block(spark):
    df = index_stream(spark, blocks=lambda i: int(i >= 50))
    got, w = emitted(spark, df, 10, 3)
    assert got and all(r.end_index <= 50 or r.start_index >= 50 for r in got)
    stats = windows.window_stats(w, spark.createDataFrame([("a", 100)], "series string, n_rows long"), AXIS, 10, 3).first()
    assert stats.n_skipped_noncontiguous > 0 and stats.n_candidate == stats.n_emitted + stats.n_skipped_noncontiguous
    assert stats.trailing_rows_dropped == 0


def test_validity_share(spark):
    strict, _ = emitted(spark, index_stream(spark, valid=lambda i: not 20 <= i < 25), 10, 10, min_valid_fraction=1.0)
    assert [r.start_index for r in strict] == [0, 10, 30, 40, 50, 60, 70, 80, 90]
    loose, _ = emitted(spark, index_stream(spark, valid=lambda i: not 20 <= i < 22), 10, 10, min_valid_fraction=0.5)
    assert [r.valid_fraction for r in loose if r.start_index == 20] == [0.8]


@pytest.mark.parametrize("size,step", [(10, 5), (7, 3), (5, 9), (1, 1), (12, 12)])
def test_features_equal_brute_force(spark, size, step):
    rnd = random.Random(size * step)
    n = 83
    x = [rnd.gauss(0, 1) for _ in range(n)]
    s = [rnd.randrange(3) for _ in range(n)]
    df = spark.createDataFrame([("a", i, x[i], s[i]) for i in range(n)], "series string, row_idx long, x double, s int").repartition(3)
    out = windows.sliding_windows(df, AXIS, size, step, continuous=["x"], discrete=["s"], label="s", positive=2)
    got = {r.start_index: r for r in out.collect()}
    assert sorted(got) == list(range(0, n - size + 1, step))
    for lo, r in got.items():
        xs, ss = x[lo: lo + size], s[lo: lo + size]
        assert abs(r["x__mean"] - statistics.fmean(xs)) < 1e-9 and abs(r["x__std"] - statistics.pstdev(xs)) < 1e-7
        assert (r["x__min"], r["x__max"], r["x__last"]) == (min(xs), max(xs), xs[-1])
        if size > 1:
            c = [i - (size - 1) / 2 for i in range(size)]
            assert abs(r["x__slope"] - sum(a * b for a, b in zip(c, xs)) / sum(a * a for a in c)) < 1e-9
        best = max(ss.count(v) for v in ss)
        mode = min(v for v in ss if ss.count(v) == best)
        assert r["s__mode"] == mode and r.label_majority == mode
        assert r["s__n_changes"] == sum(a != b for a, b in zip(ss, ss[1:]))
        assert (r.label_first, r.label_last, r.n_positive) == (ss[0], ss[-1], ss.count(2))


def test_feature_names_are_channel_major():
    assert windows.feature_names(["a", "b"], ["s"], ["mean", "max"]) == ["a__mean", "a__max", "b__mean", "b__max", "s__mode", "s__n_changes"]
    with pytest.raises(ValueError):
        windows.feature_names(["a"], [], ["median"])


def test_representative_window(spark):
    rnd = random.Random(6)
    y = [int(rnd.random() < 0.2) for _ in range(200)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)] + [("b", i, 0) for i in range(50)], "series string, row_idx long, y int")
    got = windows.representative_window(df, Axis(("series",), chunk_rows=25), "y", 21, 3).collect()
    want = next(i for i in range(200 - 21 + 1) if sum(y[i: i + 10]) >= 3 and sum(y[i + 10: i + 21]) >= 3)
    assert [(r.series, r.start_index) for r in got] == [("a", want)]


def test_events_interleave(spark):
    df = index_stream(spark, 30)
    w, _ = emitted(spark, df, 10, 5)
    both = windows.interleaved_events(df, spark.createDataFrame(w), AXIS).orderBy("arrival").collect()
    assert [r.arrival for r in both] == list(range(35))
    assert [(r.row_idx, r.window_id) for r in both if r.kind == "window"] == [(9 + 5 * i, i) for i in range(5)]
    assert [b.kind for a, b in zip(both, both[1:]) if a.kind == "sample" and a.row_idx in (9, 14)] == ["window", "window"]
