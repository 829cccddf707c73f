"""A stream drained over several micro-batches gives the batch answer."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import detect, windows
from tidegauge.operators.ordering import Axis
from tidegauge.session import shared_dir
from tidegauge.streaming import stateful

AXIS = Axis(("series",))


@pytest.fixture(scope="module")
def delivered(spark):
    rnd = random.Random(21)
    rows = [(s, i, rnd.gauss(0.2 if i < 150 else 0.8, 0.05)) for s in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "series string, at long, x double")
    folder = f"{shared_dir(spark)}/delivered"
    for k in range(4):
        part = df.where((F.col("at") >= k * 75) & (F.col("at") < (k + 1) * 75))
        part.repartition(3).coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def run(spark, stream, name):
    return stateful.run_to_table(stream, f"{shared_dir(spark)}/{name}", f"{shared_dir(spark)}/{name}-state")


def test_detector_keeps_its_state_between_batches(spark, delivered):
    df, folder = delivered
    s = stateful.file_stream(spark, folder, df.schema, files_per_trigger=1)
    out = run(spark, stateful.detect_stream(s, ["series"], ["at"], "x", 0.2, clock=8), "detect")
    assert out.where("is_late").count() == 0
    got = {(r.series, r.row_idx): (r.drift_detected, r.width, r.is_persistent, round(r.smoothed_severity, 9)) for r in out.collect()}
    rows = df.withColumnRenamed("at", "row_idx")
    alarms = detect.adwin(rows, AXIS, "x", clock=8).select("series", "row_idx", "drift_detected", "width")
    both = detect.persistence_windowed(alarms, AXIS, "drift_detected", 100, 1)
    smooth = detect.severity_ema(rows, AXIS, F.least(F.lit(1.0), F.abs(F.col("x") - 0.2)))
    want = both.join(smooth, ["series", "row_idx"]).collect()
    assert got == {(r.series, r.row_idx): (r.drift_detected, r.width, r.is_persistent, round(r.smoothed_severity, 9)) for r in want}
    assert any(v[0] for v in got.values())


def test_windows_cross_batches(spark, delivered):
    df, folder = delivered
    s = stateful.file_stream(spark, folder, df.schema, files_per_trigger=1)
    out = run(spark, stateful.window_stream(s, ["series"], ["at"], "x", 40, 7), "windows")
    got = {(r.series, r.start_index): round(r["mean"], 9) for r in out.collect()}
    batch = windows.sliding_windows(df.withColumnRenamed("at", "row_idx"), AXIS, 40, 7, continuous=["x"])
    assert got == {(r.series, r.start_index): round(r["x__mean"], 9) for r in batch.collect()}


def test_late_rows_are_marked_not_folded(spark):
    folder = f"{shared_dir(spark)}/late"
    mk = lambda ids: spark.createDataFrame([("a", i, float(i)) for i in ids], "series string, at long, x double").coalesce(1)
    mk([0, 1, 4]).write.parquet(folder)
    mk([2, 5]).write.mode("append").parquet(folder)
    s = stateful.file_stream(spark, folder, mk([0]).schema, files_per_trigger=1)
    out = run(spark, stateful.window_stream(s, ["series"], ["at"], "x", 2, 1), "late-windows").collect()
    assert [r.at for r in out if r.is_late] == [2]
    assert sorted(r["mean"] for r in out if not r.is_late) == [0.5, 2.5, 4.5]


def test_feedback_join_holds_its_time_bounds(spark):
    base = f"{shared_dir(spark)}/feedback"
    p = spark.createDataFrame([(i, i * 60) for i in range(50)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    q = spark.createDataFrame([(i, i % 2, i * 60 + (i % 5) * 600 - 300) for i in range(50)], "id long, label int, s long").select("id", "label", F.timestamp_seconds("s").alias("arrival_ts"))
    p.coalesce(1).write.parquet(f"{base}/p")
    q.coalesce(1).write.parquet(f"{base}/q")
    joined = stateful.feedback_stream(
        stateful.file_stream(spark, f"{base}/p", p.schema), stateful.file_stream(spark, f"{base}/q", q.schema), ["id"], "30 MINUTES"
    )
    got = sorted(r.id for r in run(spark, joined, "feedback-out").collect())
    assert got == [i for i in range(50) if 0 <= (i % 5) * 600 - 300 <= 1800]


def test_monitor_totals_over_batches(spark):
    folder = f"{shared_dir(spark)}/log"
    cols = "series string, selected_action string, success boolean, cloud_fallback boolean, total_latency_s double"
    for k in range(3):
        spark.createDataFrame([("a", "EDGE", True, False, 0.1 * (k + 1)), (f"s{k}", "HYBRID", k != 1, True, 1.0)], cols).coalesce(1).write.mode("append").parquet(folder)
    s = stateful.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    out = stateful.run_updates(stateful.monitor_stream(s, ["series"]), f"{folder}-out", f"{folder}-state", ["series"])
    got = {r.series: (r.total_observations, r.n_edge, r.n_hybrid, r.n_failed, round(r.mean_latency_s, 9)) for r in out.collect()}
    assert got == {"a": (3, 3, 0, 0, 0.2), "s0": (1, 0, 1, 0, 1.0), "s1": (1, 0, 1, 1, 1.0), "s2": (1, 0, 1, 0, 1.0)}


def test_a_series_is_turned_into_output_by_slices(spark):
    """Many rows of one series in a batch: readings are those of one fold, and a step sees a slice at most."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from tidegauge.operators.adwin import AdaptiveWindow
    from tidegauge.session import shared_dir
    from tidegauge.streaming import stateful

    n = 2 * stateful.SLICE_ROWS + 100
    folder = f"{shared_dir(spark)}/sliced"
    df = spark.range(n).select(F.lit("a").alias("series"), ((F.col("id") * 7919) % n).alias("at"), F.lit("x" * 50).alias("text"))
    df.withColumn("x", (F.col("at") > 9000).cast("double") + (F.col("at") % 7) / 100).write.parquet(folder)
    s = stateful.file_stream(spark, folder, spark.read.parquet(folder).schema)
    out = stateful.detect_stream(s, ["series"], ["at"], "x", 0.0)
    got = sorted(map(tuple, stateful.run_to_table(out, f"{folder}-out", f"{folder}-state").select("at", "row_idx", "drift_detected", "estimation", "width", "is_late").collect()))
    window, want = AdaptiveWindow(0.002, 32), []
    for i in range(n):
        hit = window.add(float(i > 9000) + (i % 7) / 100)
        want.append((i, i, hit, window.mean, window.n, False))
    assert got == want and any(r[2] for r in got)
    out = stateful.fold_stream(s.select("series", "at"), ["series"], ["at"], lambda: 0, lambda k, part: (k, part[["at"]].assign(n=len(part))), T.StructType([T.StructField("n", T.LongType())]))
    assert stateful.run_to_table(out, f"{folder}-sizes", f"{folder}-sizes-state").agg(F.max("n")).first()[0] == stateful.SLICE_ROWS
