"""Ordered folds, drift detection, persistence and severity."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.adwin import ANEW, AdaptiveWindow
from tidegauge.operators.ordering import Axis
from tidegauge.operators.speculative import SEGMENT_ROWS, Folded, speculative_fold
from tidegauge.session import materialise

Step = Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]]
FOLD_ROWS = 1 << 22


def ordered_fold(
    df: DataFrame,
    axis: Axis,
    init: Callable[[], object],
    step: Step,
    outputs: T.StructType,
    rows_per_wave: int = FOLD_ROWS,
    last_index: int | None = None,
) -> DataFrame:
    """Run a stateful step over every series in index order.

    For state that no associative summary can carry. `step` gets the
    state and the next rows of one series as a batch and returns the new state and one
    output row per input row. All series advance together in waves of `rows_per_wave` rows
    each: a task holds one Arrow batch and one state at a time, never a series, and the
    state of a series longer than a wave travels to the next wave through a written table,
    so a lost executor repeats a part of one wave only. Most data needs a single wave.

    `last_index` is the largest index over all series, for callers that know it from a
    cheaper table; without it `df` is evaluated once more to find out. One that is too small
    is refused once there are several waves; with one wave no row depends on it.
    """
    series, idx = list(axis.series), axis.idx
    wave_no = F.floor(F.col(idx) / F.lit(rows_per_wave)).cast("long")
    kept = df.columns
    schema = T.StructType([*df.schema.fields, *outputs.fields, T.StructField("__state", T.BinaryType())])
    out_names = [f.name for f in outputs.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf[series].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1 if len(pdf) > 1 else []
            parts = []
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
                part = pdf.iloc[lo:hi]
                if key is None or tuple(ids[lo]) != key:
                    key, carried = tuple(ids[lo]), part["__state"].iloc[0]
                    state = pickle.loads(carried) if carried is not None else init()
                state, got = step(state, part)
                res = part[kept].reset_index(drop=True)
                for name in out_names:
                    res[name] = got[name].to_numpy()
                blob = [None] * len(res)
                if (int(part[idx].iloc[-1]) + 1) % rows_per_wave == 0:
                    blob[-1] = pickle.dumps(state)
                res["__state"] = blob
                parts.append(res)
            yield pd.concat(parts, ignore_index=True)

    def one_wave(rows: DataFrame, states: DataFrame | None) -> DataFrame:
        if states is None:
            rows = rows.withColumn("__state", F.lit(None).cast("binary"))
        else:
            rows = rows.join(states, [*series, idx], "left").select(*kept, "__state")
        return rows.repartition(*series).sortWithinPartitions(*series, idx).mapInPandas(run, schema)

    if last_index is None:
        last_index = df.agg(F.max(idx)).first()[0] or 0
    last = last_index // rows_per_wave
    if last == 0:
        return one_wave(df, None).drop("__state")
    results, states = [], None
    table = materialise(df.withColumn("__wave", wave_no), "waves")  # read once per wave
    largest = table.agg(F.max(idx)).first()[0] or 0
    if largest > last_index:
        raise ValueError(f"last_index={last_index}, but the rows go up to {largest}")
    for wave in range(last + 1):
        done = materialise(one_wave(table.where(F.col("__wave") == wave).drop("__wave"), states), "fold")
        results.append(done.drop("__state"))
        states = done.where(F.col("__state").isNotNull()).select(
            *series, (F.col(idx) + 1).alias(idx), "__state"
        )
    return reduce(DataFrame.unionByName, results)


ADWIN_FIELDS = T.StructType(
    [
        T.StructField("drift_detected", T.BooleanType()),
        T.StructField("estimation", T.DoubleType()),
        T.StructField("variance", T.DoubleType()),
        T.StructField("width", T.LongType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("n_alarms", T.LongType()),
    ]
)


class Detector:
    """The adaptive window as a machine over `value` (and `weight`, `m2` of pre-aggregated rows)."""

    outputs, warm = ADWIN_FIELDS, 0

    def __init__(self, binned: bool, *settings):
        self.binned, self.settings = binned, settings

    def start(self) -> AdaptiveWindow:
        return AdaptiveWindow(*self.settings)

    def _columns(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(part)
        if self.binned:
            return part["value"].to_numpy(), part["weight"].to_numpy(), part["m2"].to_numpy()
        return part["value"].to_numpy(), np.ones(n, dtype=np.int64), np.zeros(n)

    def step(self, state: AdaptiveWindow, part: pd.DataFrame) -> tuple[AdaptiveWindow, pd.DataFrame]:
        rows = []
        for x, w, s in zip(*(c.tolist() for c in self._columns(part))):
            hit = state.add(x, int(w), s)
            rows.append((hit, state.mean, state.variance, state.n, state.total, state.alarms))
        return state, pd.DataFrame(rows, columns=self.outputs.names)

    def frozen(self, state: AdaptiveWindow) -> bytes:
        return state.frozen()

    def thawed(self, data: bytes) -> AdaptiveWindow:
        return self.start().thawed(data)

    def summary(self, part: pd.DataFrame, start: int) -> bytes:
        return pickle.dumps(self.start().summary(*self._columns(part), start))

    def advance(self, state: AdaptiveWindow, summary: bytes, rows: int) -> AdaptiveWindow:
        return state.advanced(pickle.loads(summary), rows)


def adwin_folded(
    df: DataFrame,
    axis: Axis,
    value: str,
    delta: float = 0.002,
    clock: int = 32,
    max_buckets: int = 5,
    min_window: int = 5,
    grace: int = 10,
    bin_rows: int = 1,
    segment_rows: int = SEGMENT_ROWS,
    last_index: int | None = None,
) -> Folded:
    """Adaptive-window alarms per row, and how many segments had to run again for them.

    A window depends on everything since its last cut, but cuts are rare: every segment starts from the window that its
    predecessors' buckets give if none of them cuts, and runs again only if one did. `bin_rows` > 1 pre-aggregates that many
    consecutive rows into one weighted bucket first; readings are then per bin, under the bin's last row.
    """
    if segment_rows < ANEW:
        raise ValueError(f"segment_rows={segment_rows} must be at least {ANEW}")
    slim = df.select(*axis.series, axis.idx, F.col(value).cast("double").alias("value"))
    over = axis
    if bin_rows > 1:
        bins = F.floor(F.col(axis.idx) / F.lit(bin_rows)).cast("long")
        slim = slim.groupBy(*axis.series, bins.alias("__bin")).agg(
            F.max(axis.idx).alias(axis.idx),
            F.avg("value").alias("value"),
            F.count("*").alias("weight"),
            (F.var_pop("value") * F.count("*")).alias("m2"),
        )
        over = Axis(axis.series, "__bin", axis.chunk_rows)
    machine = Detector(bin_rows > 1, delta, max(1, clock // bin_rows), max_buckets, min_window, grace)
    last = None if last_index is None else last_index // bin_rows
    out = speculative_fold(slim, over, machine, segment_rows, last)
    rows = out.rows.select(*axis.series, axis.idx, "value", *ADWIN_FIELDS.names)
    return Folded(rows, out.segments, out.again, out.rounds)


def adwin(df: DataFrame, axis: Axis, value: str, **options) -> DataFrame:
    """Adaptive-window alarms per row: series, index, value and the detector's readings (see `adwin_folded`)."""
    return adwin_folded(df, axis, value, **options).rows


def persistence_consecutive(df: DataFrame, axis: Axis, alarm: str, k: int = 3) -> DataFrame:
    """Add `is_persistent`: the last k rows up to now are all alarms."""
    count = {"__hits": lambda w: F.sum(F.col(alarm).cast("long")).over(w.rowsBetween(-(k - 1), 0))}
    out = axis.bounded(df, count, back=k - 1)
    return out.withColumn("is_persistent", F.col("__hits") >= k).drop("__hits")


def persistence_windowed(df: DataFrame, axis: Axis, alarm: str, width: int = 100, count: int = 1) -> DataFrame:
    """Add `alarms_in_window` and `is_persistent`: at least `count` alarms in the last `width` rows."""
    hits = {"alarms_in_window": lambda w: F.sum(F.col(alarm).cast("long")).over(w.rowsBetween(-(width - 1), 0))}
    out = axis.bounded(df, hits, back=width - 1)
    return out.withColumn("is_persistent", F.col("alarms_in_window") >= count)


def alarm_rate(df: DataFrame, axis: Axis, alarm: str) -> DataFrame:
    """Add `total_alarms` and `alarm_rate`, both up to the current row."""
    out = axis.running(df, sums={"total_alarms": F.col(alarm).cast("long")})
    return out.withColumn("alarm_rate", F.col("total_alarms") / (F.col(axis.idx) + 1))


def severity_ema(df: DataFrame, axis: Axis, raw: Column, alpha: float = 0.8) -> DataFrame:
    """Add `raw_severity` and `smoothed_severity`."""
    return axis.ema(
        df.withColumn("raw_severity", raw), "smoothed_severity", F.col("raw_severity"), alpha
    )


def severity_history(df: DataFrame, axis: Axis, alarm: str) -> DataFrame:
    """Per series: updates, alarms, largest raw severity, last smoothed severity."""
    return df.groupBy(*axis.series).agg(
        F.count("*").alias("total_updates"),
        F.count_if(F.col(alarm)).alias("total_alarms"),
        F.max("raw_severity").alias("max_raw_severity"),
        F.max_by("smoothed_severity", axis.idx).alias("last_smoothed_severity"),
    )
