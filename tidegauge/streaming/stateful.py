"""Structured Streaming counterparts of the ordered operators.

Per-series state lives in the state store, so a lost executor restores it from the last
checkpoint. A micro-batch brings one series' new rows together; its size is bounded by the
source's admission options (maxFilesPerTrigger, maxBytesPerTrigger), and the state by the
window size or the detector's O(log n) buckets. Rows that arrive behind the last one folded
are not mixed in: they come out marked as late.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators.adwin import AdaptiveWindow

#: Rows of a series that a task turns into output at a time.
SLICE_ROWS = 1 << 14

STATE = T.StructType([T.StructField("last", T.BinaryType()), T.StructField("blob", T.BinaryType())])


def fold_stream(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    init: Callable[[], object],
    step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]],
    outputs: T.StructType,
) -> DataFrame:
    """Feed each series' rows to `step` in `order`; output columns are the series, `outputs`
    and `is_late`. A late row passes by `step` and appears with empty outputs.

    A task holds a series' new rows, so `df` should have no more columns than `order` and `step` need; their outputs are made
    a slice at a time."""
    keys = T.StructType([df.schema[c] for c in series])
    places = T.StructType([df.schema[c] for c in order])
    schema = T.StructType([*keys.fields, *places.fields, *outputs.fields, T.StructField("is_late", T.BooleanType())])
    order = list(order)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = (pickle.loads(b) for b in state.get) if state.exists else (None, init())
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        passed = last  # what the batches before have folded
        for lo in range(0, len(rows), SLICE_ROWS):
            some = rows.iloc[lo : lo + SLICE_ROWS]
            places = list(some[order].itertuples(index=False, name=None))
            late = pd.Series([passed is not None and p <= passed for p in places], dtype=bool)
            fresh = some[~late.to_numpy()].reset_index(drop=True)
            parts = []
            if len(fresh):
                held, got = step(held, fresh)
                last = tuple(fresh[order].iloc[-1])
                parts.append(got.assign(is_late=False))
            if late.any():
                behind = some.loc[late.to_numpy(), order].reset_index(drop=True)
                parts.append(behind.reindex(columns=[f.name for f in schema.fields[len(key):-1]]).assign(is_late=True))
            out = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            for name, value in zip(series, key):
                out[name] = value
            yield out[[f.name for f in schema.fields]]
        state.update((pickle.dumps(last), pickle.dumps(held)))

    return df.groupBy(*series).applyInPandasWithState(
        run, schema, STATE, "append", GroupStateTimeout.NoTimeout
    )


DETECT_FIELDS = T.StructType(
    [
        T.StructField("row_idx", T.LongType()),
        T.StructField("drift_detected", T.BooleanType()),
        T.StructField("is_persistent", T.BooleanType()),
        T.StructField("estimation", T.DoubleType()),
        T.StructField("width", T.LongType()),
        T.StructField("smoothed_severity", T.DoubleType()),
    ]
)


def detect_stream(
    df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, baseline_mean: float,
    delta: float = 0.002, clock: int = 32, width: int = 100, count: int = 1, alpha: float = 0.8, max_shift: float = 1.0,
) -> DataFrame:
    """Detector, windowed persistence and smoothed severity, online."""
    order = list(order)

    def step(state, rows: pd.DataFrame):
        detector, n, recent, smooth = state
        out = []
        for x in rows[value].tolist():
            hit = detector.add(x)
            if hit:
                recent.append(n)
            recent = [i for i in recent if i > n - width]
            raw = min(1.0, abs(x - baseline_mean) / max_shift)
            smooth = raw if smooth is None else alpha * smooth + (1.0 - alpha) * raw
            out.append((n, hit, len(recent) >= count, detector.mean, detector.n, smooth))
            n += 1
        got = pd.DataFrame(out, columns=[f.name for f in DETECT_FIELDS.fields])
        return (detector, n, recent, smooth), pd.concat([rows[order].reset_index(drop=True), got], axis=1)

    init = lambda: (AdaptiveWindow(delta, clock), 0, [], None)
    return fold_stream(df.select(*dict.fromkeys([*series, *order, value])), series, order, init, step, DETECT_FIELDS)


WINDOW_FIELDS = T.StructType(
    [
        T.StructField("start_index", T.LongType()),
        T.StructField("end_index", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("minimum", T.DoubleType()),
        T.StructField("maximum", T.DoubleType()),
    ]
)


def window_stream(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, size: int, step_rows: int) -> DataFrame:
    """Count windows online: emitted with the row that completes them, never before.

    The state keeps the values of the rows an open window still needs.
    """
    order = list(order)

    def step(state, rows: pd.DataFrame):
        n, ring = state
        out = []
        for place, x in zip(rows[order].itertuples(index=False, name=None), rows[value].tolist()):
            ring.append(x)
            n += 1
            start = n - size
            if start >= 0 and start % step_rows == 0:
                held = ring[-size:]
                out.append((*place, start, n, sum(held) / size, min(held), max(held)))
            if len(ring) >= 2 * size:
                ring = ring[-(size - 1):] if size > 1 else []
        ring = ring[-(size - 1):] if size > 1 else []
        return (n, ring), pd.DataFrame(out, columns=[*order, *[f.name for f in WINDOW_FIELDS.fields]])

    return fold_stream(df.select(*dict.fromkeys([*series, *order, value])), series, order, lambda: (0, []), step, WINDOW_FIELDS)


def feedback_stream(predictions: DataFrame, labels: DataFrame, key: Sequence[str], max_delay: str, lateness: str = "1 hour", how: str = "inner") -> DataFrame:
    """Late labels meet their predictions: an interval join with watermarks on both sides.

    Both sides carry an event time (`ts`, `arrival_ts`); a label counts when it arrives no
    earlier than its prediction and within `max_delay`. The bounds let the state be dropped.

    With "left_outer" a prediction comes out without a label once the watermark says that none can come any more, with
    "full_outer" also a label that came too late for its prediction, or for none, with its key and empty otherwise. A drained
    stream needs a closing row on either side for that (see `ordered.closing`).
    """
    p = predictions.withWatermark("ts", lateness)
    q = labels.select(*[F.col(k).alias(f"l_{k}") for k in key], "label", "arrival_ts").withWatermark("arrival_ts", lateness)
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"l_{k}"))
    in_time = (F.col("arrival_ts") >= F.col("ts")) & (F.col("arrival_ts") <= F.col("ts") + F.expr(f"INTERVAL {max_delay}"))
    joined = p.join(q, same & in_time, how)
    named = [F.coalesce(c, f"l_{c}").alias(c) if c in key else F.col(c) for c in predictions.columns]
    return joined.select(*named, "label", "arrival_ts")


def monitor_stream(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running totals of a telemetry stream (use with complete or update output)."""
    act = F.col("selected_action")
    return log.groupBy(*by).agg(
        F.count("*").alias("total_observations"),
        *[F.count_if(act == a).alias(f"n_{a.lower()}") for a in ("EDGE", "CLOUD", "HYBRID")],
        F.count_if(~F.col("success")).alias("n_failed"),
        F.count_if(F.col("cloud_fallback")).alias("n_fallbacks"),
        F.avg("total_latency_s").alias("mean_latency_s"),
        F.max("total_latency_s").alias("max_latency_s"),
    )


class Monitor:
    """Online telemetry: an alert row for every row with an alert, and the newest rows of every key.

    A micro-batch is written under its number: `alerts/batch=N` and a snapshot `newest/batch=N` made of the snapshot before it and
    the batch. Both are overwritten if the batch comes again, and a snapshot is made from the newest one of a smaller number, so a
    replay changes nothing. A snapshot holds at most `newest` rows a key, however long the stream; older ones are not read.
    """

    def __init__(self, path: str, by: Sequence[str], order: str, newest: int, alerts: Column):
        self.path, self.by, self.order, self.newest, self.alerts = path.rstrip("/"), list(by), order, newest, alerts

    def save(self, batch: DataFrame, number: int) -> None:
        told = batch.withColumn("alerts", self.alerts)
        told.where(F.size("alerts") > 0).select(*self.by, self.order, F.explode("alerts").alias("alert")).write.mode("overwrite").parquet(f"{self.path}/alerts/batch={number}")
        before = self._snapshot(batch.sparkSession, batch.schema, number)
        both = batch if before is None else before.unionByName(batch)
        w = Window.partitionBy(*self.by).orderBy(F.desc(self.order))
        kept = both.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= self.newest).drop("__place")
        kept.write.mode("overwrite").parquet(f"{self.path}/newest/batch={number}")

    def _snapshot(self, spark: SparkSession, schema: T.StructType, before: int) -> DataFrame | None:
        if not before:
            return None
        every = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.path}/newest")
        last = every.where(F.col("batch") < before).agg(F.max("batch")).first()[0]
        return None if last is None else every.where(F.col("batch") == last).drop("batch")

    def run(self, stream: DataFrame, checkpoint: str) -> tuple[DataFrame, DataFrame]:
        """Drain what is available; all alerts so far, and the newest rows of every key."""
        query = stream.writeStream.foreachBatch(self.save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        spark = stream.sparkSession
        keys = [stream.schema[c] for c in (*self.by, self.order)]
        alerts = spark.read.schema(T.StructType([*keys, T.StructField("alert", T.StringType()), T.StructField("batch", T.LongType())])).parquet(f"{self.path}/alerts")
        newest = self._snapshot(spark, stream.schema, 1 << 62)
        return alerts.drop("batch"), newest


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what is available into a parquet table, exactly once, and read it."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, path: str, checkpoint: str, by: Sequence[str]) -> DataFrame:
    """Write every micro-batch's changed totals with its number; the newest per key is the state."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/update-{number:08d}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    every = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    values = [c for c in stream.columns if c not in by]
    newest = every.groupBy(*by).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*by, "v.*")


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A folder of parquet files as a stream, admitted a bounded number at a time."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )
