"""Streams put in order: a reorder buffer with event-time timers, and count windows over what it releases.

Rows of a series wait in a map state under the slot of time that their stamp lies in until the watermark has passed all of it;
then a timer releases them, in order, with the number that a batch job would give them. What comes when the watermark has passed
its stamp is not mixed in: it comes out marked as late. A slot is a part of the lateness, so what waits is little more than what
may still change, and the store is asked per slot and delivery, not per row. State is typed and lives in a RocksDB store, an entry
for each batch of a slot that is open: none is written twice, a task never holds more of a series than one slot's rows and the
values of a window, and a restart goes on where the checkpoint left off.

A stateful operator drops rows behind the watermark unseen. So the watermark is driven by a clock column beside the rows, which
is null on the rows themselves: none is dropped, and the late ones can be told. A drained stream ends with rows still open; a
closing row far ahead in time (`closing`), in any series, lets the watermark pass all of them, and is not released itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_CLOCK = "__clock"
#: Slots that the lateness is divided into.
SLOTS = 8
#: What typed state in several column families needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*STORE)


def slot_of(spark: SparkSession, lateness: str) -> int:
    """Milliseconds of a slot under this lateness."""
    late = spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {lateness})")).first()[0]
    return max(1, late // SLOTS)


def _clocked(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """`df` under a watermark that its own stamps drive, but which drops none of its rows."""
    row = F.struct(*[F.col(c) for c in df.columns])
    none = F.lit(None).cast(T.StructType(df.schema.fields))
    both = F.array(F.struct(row.alias("row"), F.lit(None).cast("timestamp").alias("clock")), F.struct(none.alias("row"), F.col(ts).cast("timestamp").alias("clock")))
    ticking = df.select(F.explode(both).alias("x")).select("x.row", F.col("x.clock").alias(_CLOCK)).withWatermark(_CLOCK, lateness)
    # The test names the clock, so it is not moved below the watermark.
    return ticking.where(F.col(_CLOCK).isNull()).select("row.*", _CLOCK)


class Reorder(StatefulProcessor):
    """Releases the rows of a series in the order of (stamp, tie)."""

    def __init__(self, series: Sequence[str], ts: str, tie: str, kept: T.StructType, slot_ms: int):
        self.series, self.ts, self.tie, self.kept, self.slot_ms = list(series), ts, tie, kept, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = [T.StructField("us", T.ArrayType(T.LongType())), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.kept.fields]]
        self.open = handle.getMapState("open", "slot long, part int", T.StructType(columns))
        self.parts = handle.getMapState("parts", "slot long", "n int")
        self.released = handle.getValueState("released", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() or float("-inf")  # zero: no watermark yet
        for frame in rows:
            us = frame[self.ts].astype("datetime64[us]").astype("int64")
            ms = us // 1000
            frame = frame.assign(__us=us, __slot=ms // self.slot_ms)
            late = frame[ms <= passed]
            if len(late):
                yield self.shown(key, late, [None] * len(late), True)
            for slot, some in frame[ms > passed].groupby("__slot", sort=False):
                slot = int(slot)
                held = self.parts.getValue((slot,))
                part = held[0] if held is not None else 0
                if not part:
                    self.handle.registerTimer((slot + 1) * self.slot_ms - 1)
                self.open.updateValue((slot, part), tuple(some[c].tolist() for c in ("__us", *self.kept.names)))
                self.parts.updateValue((slot,), (part + 1,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms
        held = self.parts.getValue((slot,))
        if held is None:
            return
        columns: list[list] = [[] for _ in range(1 + len(self.kept.names))]
        for part in range(held[0]):
            for column, more in zip(columns, self.open.getValue((slot, part))):
                column.extend(more)
            self.open.removeKey((slot, part))
        self.parts.removeKey((slot,))
        frame = pd.DataFrame(dict(zip(("__us", *self.kept.names), columns))).sort_values(["__us", self.tie], kind="stable", ignore_index=True)
        n = self.released.get()[0] if self.released.exists() else 0
        self.released.update((n + len(frame),))
        yield from self.let_go(key, frame, n)

    def let_go(self, key: tuple, frame: pd.DataFrame, n: int) -> Iterator[pd.DataFrame]:
        """What comes of rows that are in order now; n were released before."""
        yield self.shown(key, frame, range(n, n + len(frame)), False)

    def shown(self, key: tuple, frame: pd.DataFrame, places, late: bool) -> pd.DataFrame:
        out = pd.DataFrame({c: [v] * len(frame) for c, v in zip(self.series, key)})
        for c in self.kept.names:
            out[c] = frame[c].tolist()
        out[self.ts] = pd.to_datetime(frame["__us"].tolist(), unit="us")
        out["row_idx"] = pd.array(list(places), dtype="Int64")
        out["is_late"] = late
        return out

    def close(self) -> None:
        pass


class OrderedWindows(Reorder):
    """Count windows over the released rows: the state keeps the values that an open window still needs, one entry each."""

    def __init__(self, series: Sequence[str], ts: str, tie: str, kept: T.StructType, slot_ms: int, value: str, size: int, step: int):
        super().__init__(series, ts, tie, kept, slot_ms)
        self.value, self.size, self.step = value, size, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "value double")

    def let_go(self, key: tuple, frame: pd.DataFrame, n: int) -> Iterator[pd.DataFrame]:
        ring = [x for x, in self.ring.get()] if self.ring.exists() else []
        rows = []
        for x in frame[self.value].tolist():
            ring.append(x)
            n += 1
            start = n - self.size
            if start >= 0 and start % self.step == 0:
                held = ring[-self.size:]
                rows.append((*key, start, n, sum(held) / self.size, min(held), max(held), False))
            if len(ring) > 2 * self.size:
                del ring[: -self.size]
        self.ring.put([(x,) for x in ring[-self.size:]])
        if rows:
            yield pd.DataFrame(rows, columns=[*self.series, *_WINDOW, "is_late"])

    def shown(self, key: tuple, frame: pd.DataFrame, places, late: bool) -> pd.DataFrame:
        out = pd.DataFrame({c: [v] * len(frame) for c, v in zip(self.series, key)})
        for c in _WINDOW:
            out[c] = pd.array([None] * len(frame), dtype="Int64" if c.endswith("index") else "Float64")
        out["is_late"] = late
        return out


_WINDOW = ("start_index", "end_index", "mean", "minimum", "maximum")


def _processed(df: DataFrame, series: Sequence[str], ts: str, lateness: str, processor: Reorder, output: T.StructType) -> DataFrame:
    use_rocksdb(df.sparkSession)
    return _clocked(df, ts, lateness).groupBy(*series).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime"
    )


def _kept(df: DataFrame, series: Sequence[str], ts: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in (*series, ts)])


def ordered_stream(df: DataFrame, series: Sequence[str], ts: str, tie: str, lateness: str) -> DataFrame:
    """The rows with their `row_idx` in the series by (stamp, tie), and late ones without, as `is_late`.

    Rows may come in any order within `lateness` of event time; `ts` is a timestamp, `tie` a number that tells equal stamps
    apart. Equal to numbering the whole table, if nothing is late.
    """
    kept = _kept(df, series, ts)
    output = T.StructType([*[df.schema[c] for c in series], *kept.fields, df.schema[ts], T.StructField("row_idx", T.LongType()), T.StructField("is_late", T.BooleanType())])
    return _processed(df, series, ts, lateness, Reorder(series, ts, tie, kept, slot_of(df.sparkSession, lateness)), output)


def ordered_windows(df: DataFrame, series: Sequence[str], ts: str, tie: str, value: str, size: int, step: int, lateness: str) -> DataFrame:
    """Count windows of `size` rows, every `step` rows, over the ordered stream; a late row appears with empty readings."""
    kept = _kept(df.select(*series, ts, tie, value), series, ts)
    numbers = [T.StructField(c, T.LongType() if c.endswith("index") else T.DoubleType()) for c in _WINDOW]
    output = T.StructType([*[df.schema[c] for c in series], *numbers, T.StructField("is_late", T.BooleanType())])
    windows = OrderedWindows(series, ts, tie, kept, slot_of(df.sparkSession, lateness), value, size, step)
    return _processed(df.select(*series, ts, tie, value), series, ts, lateness, windows, output)


def closing(df: DataFrame, ts: str, at: str = "2100-01-01 00:00:00") -> DataFrame:
    """One row like those of `df`, far ahead in time: a last delivery that lets everything before it go."""
    cells = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(-1).cast(f.dataType).alias(f.name) if isinstance(f.dataType, T.NumericType) else F.lit("").cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.sparkSession.range(1).select(*cells)
