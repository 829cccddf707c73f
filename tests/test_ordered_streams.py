"""Streams in order, windows over them, outer feedback and the online monitor, in many small batches and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import windows
from tidegauge.operators.ordering import Axis
from tidegauge.session import shared_dir
from tidegauge.streaming import ordered, stateful

AXIS = Axis(("series",))
SCHEMA = "series string, id long, s long, x double"


def rows_of(n, seed):
    """Rows with equal stamps among them, and a random delay of at most 500 seconds each."""
    r = random.Random(seed)
    rows = [(f"d{i % 3}", i, (i // 5) * 40, r.gauss(0, 1)) for i in range(n)]
    return sorted(rows, key=lambda x: x[2] + r.random() * 500)


def deliver(spark, folder, rows, sizes):
    at = 0
    for n in sizes:
        df = spark.createDataFrame(rows[at : at + n], SCHEMA).select("series", "id", F.timestamp_seconds("s").alias("ts"), "x")
        df.coalesce(1).write.mode("append").parquet(folder)
        at += n
    return df.schema


def close(spark, folder, schema):
    ordered.closing(spark.createDataFrame([], schema), "ts").write.mode("append").parquet(folder)


def test_shuffled_rows_come_out_in_order_after_a_restart(spark):
    base = f"{shared_dir(spark)}/reorder"
    rows = rows_of(240, 1)
    schema = deliver(spark, f"{base}/in", rows, [60, 60])
    run = lambda: stateful.run_to_table(
        ordered.ordered_stream(stateful.file_stream(spark, f"{base}/in", schema, files_per_trigger=1), ["series"], "ts", "id", "600 seconds"), f"{base}/out", f"{base}/state"
    )
    run()
    # A new query on the same checkpoint goes on with the rows that are still open.
    deliver(spark, f"{base}/in", rows[120:], [50, 70])
    close(spark, f"{base}/in", schema)
    got = run().where("id >= 0").collect()
    want = {}
    for s in ("d0", "d1", "d2"):
        for n, x in enumerate(sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1]))):
            want[x[1]] = (s, n, x[3])
    assert not any(r.is_late for r in got)
    assert {r.id: (r.series, r.row_idx, r.x) for r in got} == want and len(got) == len(rows)


def test_rows_behind_the_watermark_are_told(spark):
    base = f"{shared_dir(spark)}/behind"
    rows = [("d0", 1, 0, 1.0), ("d0", 2, 10_000, 1.0), ("d0", 3, 5_000, 1.0), ("d0", 4, 20_000, 1.0), ("d1", 5, 100, 1.0)]
    schema = deliver(spark, f"{base}/in", rows, [2, 1, 2])
    close(spark, f"{base}/in", schema)
    out = stateful.run_to_table(
        ordered.ordered_stream(stateful.file_stream(spark, f"{base}/in", schema, files_per_trigger=1), ["series"], "ts", "id", "100 seconds"), f"{base}/out", f"{base}/state"
    )
    got = {r.id: (r.row_idx, r.is_late) for r in out.where("id >= 0").collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (None, True), 4: (2, False), 5: (None, True)}


def test_windows_over_shuffled_batches_equal_the_batch_answer(spark):
    base = f"{shared_dir(spark)}/ordered-windows"
    rows = rows_of(200, 2)
    schema = deliver(spark, f"{base}/in", rows, [30, 50, 40, 80])
    close(spark, f"{base}/in", schema)
    s = stateful.file_stream(spark, f"{base}/in", schema, files_per_trigger=1)
    out = stateful.run_to_table(ordered.ordered_windows(s, ["series"], "ts", "id", "x", 12, 5, "600 seconds"), f"{base}/out", f"{base}/state")
    assert out.where("is_late").count() == 0
    numbered = [(s, n, x[3]) for s in ("d0", "d1", "d2") for n, x in enumerate(sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1])))]
    batch = windows.sliding_windows(spark.createDataFrame(numbered, "series string, row_idx long, x double"), AXIS, 12, 5, continuous=["x"])
    shown = lambda some: sorted((r[0], r[1], round(r[2], 9)) for r in some)
    assert shown(out.select("series", "start_index", "mean").collect()) == shown(batch.select("series", "start_index", "x__mean").collect())


@pytest.mark.parametrize("how", ["left_outer", "full_outer"])
def test_feedback_ends_open_predictions_and_tells_late_labels(spark, how):
    base = f"{shared_dir(spark)}/outer-{how}"
    p = spark.createDataFrame([(i, 10**6 + i * 60) for i in range(50)] + [(-1, 10**9)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    late = lambda i: (i % 5) * 600 - 300
    q = spark.createDataFrame([(i, i % 2, 10**6 + i * 60 + late(i)) for i in range(50)] + [(-2, 0, 10**9)], "id long, label int, s long").select("id", "label", F.timestamp_seconds("s").alias("arrival_ts"))
    p.coalesce(1).write.parquet(f"{base}/p")
    q.coalesce(1).write.parquet(f"{base}/q")
    joined = stateful.feedback_stream(stateful.file_stream(spark, f"{base}/p", p.schema), stateful.file_stream(spark, f"{base}/q", q.schema), ["id"], "30 MINUTES", how=how)
    out = stateful.run_to_table(joined, f"{base}/out", f"{base}/state").where("id >= 0").collect()
    met = {i for i in range(50) if 0 <= late(i) <= 1800}
    assert {r.id for r in out if r.ts and r.label is not None} == met
    assert {r.id for r in out if r.ts and r.label is None} == set(range(50)) - met
    assert {r.id for r in out if not r.ts} == (set(range(50)) - met if how == "full_outer" else set())


def test_monitor_raises_alerts_and_holds_the_newest_rows(spark):
    folder = f"{shared_dir(spark)}/watched"
    cols = "series string, row_idx long, x double"
    for k in range(4):
        spark.createDataFrame([(f"d{i % 2}", k * 10 + i, float(i)) for i in range(10)], cols).coalesce(1).write.mode("append").parquet(folder)
    names = F.array_compact(F.array(F.when(F.col("x") > 7, F.lit("high")), F.when(F.col("x") == 9, F.lit("nine"))))
    watch = stateful.Monitor(f"{folder}-out", ["series"], "row_idx", 3, names)
    stream = stateful.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    alerts, newest = watch.run(stream, f"{folder}-state")
    told = lambda a: sorted((r.series, r.row_idx, r.alert) for r in a.collect())
    want = sorted((f"d{i % 2}", k * 10 + i, n) for k in range(4) for i in (8, 9) for n in (["high", "nine"] if i == 9 else ["high"]))
    held = [("d0", 34), ("d0", 36), ("d0", 38), ("d1", 35), ("d1", 37), ("d1", 39)]
    assert told(alerts) == want and sorted((r.series, r.row_idx) for r in newest.collect()) == held
    # The last batch comes again.
    watch.save(spark.createDataFrame([(f"d{i % 2}", 30 + i, float(i)) for i in range(10)], cols), 3)
    alerts, newest = watch.run(stream, f"{folder}-state")
    assert told(alerts) == want and sorted((r.series, r.row_idx) for r in newest.collect()) == held


def test_the_store_is_asked_per_slot_and_not_per_row():
    import pandas as pd
    from pyspark.sql import types as T

    calls = []

    class Store(dict):
        def getValue(self, k):
            calls.append(k)
            return self.get(k)

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

    class Timers:
        getCurrentWatermarkInMs = staticmethod(lambda: 1_000_000)
        registerTimer = staticmethod(calls.append)

    it = ordered.Reorder(["series"], "ts", "id", T.StructType([T.StructField("id", T.LongType())]), 60_000)
    it.handle, it.open, it.parts = Timers, Store(), Store()
    ms = pd.Series(range(960_000, 1_200_000, 40))
    frame = pd.DataFrame({"series": "d0", "id": range(len(ms)), "ts": pd.to_datetime(ms, unit="ms")})
    out = list(it.handleInputRows(("d0",), iter([frame, frame]), Timers))
    assert sum(len(x) for x in out) == 2 * 1001  # up to the watermark
    assert sum(len(v[0]) for v in it.open.values()) == 2 * (len(ms) - 1001) and len(calls) <= 2 * 4 * 4
