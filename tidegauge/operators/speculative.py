"""Speculative parallel folds: the segments of one series run at once, each from a state it assumes.

A state that no associative summary can carry forces an order on the rows of a series, but not on the work. The series is
cut into segments, all of them run in parallel, and a segment stands if the end state of the one before equals, byte for byte,
the state it assumed; only those that don't are run again, from that end state, until all stand. By induction from the first
segment the result is that of the plain loop, whatever was assumed: a wrong guess costs a run, never a row.

Where the assumed state comes from is the machine's business:

* `warm` rows before the segment, fed to a fresh state: for states that forget, such as smoothed errors and controllers;
* `summary` and `advance`: a summary of every segment, made in parallel, and a state that is carried over the summaries on the
  assumption that nothing exceptional happens in them: for detectors, which are changed by their rare alarms only.

A task holds one Arrow batch and one state. States travel in narrow written tables, a row per segment, so a lost executor costs
the part of a run that it held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.ordering import Axis
from tidegauge.session import materialise, passing

SEGMENT_ROWS = 1 << 16
#: Segments that a state is carried over at most in one round, and at least after a round in which little stood.
AHEAD, LEAST_AHEAD = 4096, 16


class Machine(Protocol):
    """A state machine over rows; `warm` and the pair `summary`, `advance` are two ways to guess a state."""

    outputs: T.StructType
    warm: int  # rows before a segment that a fresh state is fed; 0: states are carried over summaries instead

    def start(self) -> object: ...

    def step(self, state: object, part: pd.DataFrame) -> tuple[object, pd.DataFrame]:
        """The state after the rows, and one row of outputs for each."""

    def frozen(self, state: object) -> bytes:
        """Equal states have equal bytes."""

    def thawed(self, data: bytes) -> object: ...

    def summary(self, part: pd.DataFrame, start: int) -> bytes:
        """What `advance` needs of a whole segment that begins at this index."""

    def advance(self, state: object, summary: bytes, rows: int) -> object:
        """The state after the segment, if nothing exceptional happens in it."""


@dataclass
class Folded:
    """Rows with outputs, and how much was run for them: segments, segments run again, rounds."""

    rows: DataFrame
    segments: int = 0
    again: int = 0
    rounds: int = 1


def speculative_fold(df: DataFrame, axis: Axis, machine: Machine, segment_rows: int = SEGMENT_ROWS, last_index: int | None = None) -> Folded:
    """Run the machine over every series in index order, all segments of a series at once.

    `last_index` is the largest index of any series, for callers that know it from a cheaper table. One that is too small is
    refused once there are several segments; with one segment no row depends on it.
    """
    if not machine.warm and segment_rows & (segment_rows - 1):
        raise ValueError(f"segment_rows={segment_rows} must be a power of two")
    if machine.warm > segment_rows:
        raise ValueError(f"segment_rows={segment_rows} must be at least the {machine.warm} rows of a warm-up")
    if last_index is None:
        last_index = df.agg(F.max(axis.idx)).first()[0] or 0
    if last_index < segment_rows:
        return Folded(_run(df, axis, machine, segment_rows, None, None).drop("__assumed", "__end", "__seg"))
    with passing(df.sparkSession, "run", "ends"):  # what the rows are read from
        return _folded(df, axis, machine, segment_rows, last_index)


def _folded(df: DataFrame, axis: Axis, machine: Machine, segment_rows: int, last_index: int) -> Folded:
    """The fold of series of several segments."""
    table = materialise(df.withColumn("__seg", F.floor(F.col(axis.idx) / F.lit(segment_rows)).cast("long")), "segments")
    largest = table.agg(F.max(axis.idx)).first()[0] or 0
    if largest > last_index:
        raise ValueError(f"last_index={last_index}, but the rows go up to {largest}")
    keys = [*axis.series, "__seg"]
    every = table.select(*keys).distinct()
    first = every.where("__seg = 0").select(*keys, F.lit(machine.frozen(machine.start())).alias("__state"), F.lit(AHEAD).alias("__ahead"))
    summaries = None if machine.warm else materialise(_summaries(table, axis, machine, segment_rows), "summaries")
    todo = None if machine.warm else materialise(_assumed(first, summaries, axis, machine, segment_rows), "assumed")
    runs: list[DataFrame] = []
    current: DataFrame | None = None  # of every segment that has run: what it assumed, how it ended, in which run
    again = 0
    while True:
        done = materialise(_run(table, axis, machine, segment_rows, todo, None if runs else every), "run")
        ends = done.where(F.col("__assumed").isNotNull() | F.col("__end").isNotNull()).groupBy(*keys)
        ends = ends.agg(F.max("__assumed").alias("assumed"), F.max("__end").alias("end")).withColumn("run", F.lit(len(runs)))
        runs.append(done)
        if current is not None:
            ends = ends.unionByName(current.join(ends.select(*keys), keys, "left_anti"))
        current = materialise(ends, "ends")
        todo = _next(current, every, summaries, axis, machine, segment_rows)
        n = todo.count()
        if not n:
            break
        again += n
    chosen = [r.join(current.where(F.col("run") == k).select(*keys), keys, "left_semi").drop("__assumed", "__end", "__seg") for k, r in enumerate(runs)]
    n_segments = every.count()
    # Segments that were carried to for the first time in a later round have not run twice.
    first_run = runs[0].select(*keys).distinct().count() if summaries is not None else n_segments
    return Folded(reduce(DataFrame.unionByName, chosen), n_segments, again - (n_segments - first_run), len(runs))


def _run(df: DataFrame, axis: Axis, machine: Machine, segment_rows: int, todo: DataFrame | None, every: DataFrame | None) -> DataFrame:
    """The rows of the segments in `todo` (or all, after a warm-up) with outputs, the assumed state and the state at the end."""
    series, idx = list(axis.series), axis.idx
    whole = "__seg" not in df.columns
    if whole:
        df = df.withColumn("__seg", F.lit(0).cast("long"))
    kept = df.columns
    if todo is not None:
        chosen = df.join(todo.select(*series, "__seg"), [*series, "__seg"], "left_semi").withColumn("__warm", F.lit(False))
        states = todo.select(*series, (F.col("__seg") * segment_rows).alias(idx), "__state")
        chosen = chosen.join(states, [*series, idx], "left").select(*kept, "__warm", "__state")
    else:
        near_end = F.pmod(F.col(idx), F.lit(segment_rows)) >= segment_rows - machine.warm
        chosen = df.withColumn("__warm", F.lit(False))
        if machine.warm and not whole:
            ahead = df.where(near_end).withColumn("__seg", F.col("__seg") + 1).withColumn("__warm", F.lit(True))
            chosen = chosen.unionByName(ahead.join(every, [*series, "__seg"], "left_semi").select(*chosen.columns))
        chosen = chosen.withColumn("__state", F.lit(None).cast("binary"))
    fields = [*df.schema.fields, *machine.outputs.fields, T.StructField("__assumed", T.BinaryType()), T.StructField("__end", T.BinaryType())]
    names = [f.name for f in machine.outputs.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, warming = None, None, False
        held: pd.DataFrame | None = None  # the last rows so far: they end their segment if the next ones are of another

        def ended(part: pd.DataFrame) -> pd.DataFrame:
            part.iat[len(part) - 1, part.columns.get_loc("__end")] = machine.frozen(state)
            return part

        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf[[*series, "__seg", "__warm"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1 if len(pdf) > 1 else []
            parts = []
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
                part, now = pdf.iloc[lo:hi], tuple(ids[lo][:-1])
                begins = now != key
                if begins:
                    if held is not None:
                        parts.append(ended(held))
                        held = None
                    given = part["__state"].iloc[0]
                    key, state = now, machine.thawed(bytes(given)) if given is not None else machine.start()
                if ids[lo][-1]:
                    state, _ = machine.step(state, part)
                    warming = True
                    continue
                assumed = machine.frozen(state) if begins or warming else None
                warming = False
                state, got = machine.step(state, part)
                res = part[kept].reset_index(drop=True)
                for name in names:
                    res[name] = got[name].to_numpy()
                res["__assumed"] = pd.Series([assumed] + [None] * (len(res) - 1), dtype=object)
                res["__end"] = pd.Series([None] * len(res), dtype=object)
                if held is not None:
                    parts.append(held)
                held = res
            if parts:
                yield pd.concat(parts, ignore_index=True)
        if held is not None:
            yield ended(held)

    dealt = chosen.repartition(*series, "__seg").sortWithinPartitions(*series, "__seg", idx)
    return dealt.mapInPandas(run, T.StructType(fields))


def _summaries(table: DataFrame, axis: Axis, machine: Machine, segment_rows: int) -> DataFrame:
    """(series, __seg, __summary) of every whole segment."""
    series, idx = list(axis.series), axis.idx
    schema = T.StructType([*[table.schema[c] for c in series], T.StructField("__seg", T.LongType()), T.StructField("__summary", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            ids = pdf[[*series, "__seg"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1 if len(pdf) > 1 else []
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
                if held and tuple(ids[lo]) != tuple(held[0][[*series, "__seg"]].iloc[0]):
                    out += one(held)
                    held = []
                held.append(pdf.iloc[lo:hi])
            if out:
                yield pd.DataFrame(out, columns=schema.names)
        if held and (out := one(held)):
            yield pd.DataFrame(out, columns=schema.names)

    def one(held: list[pd.DataFrame]) -> list[tuple]:
        part = pd.concat(held, ignore_index=True)
        if len(part) < segment_rows:
            return []
        key = tuple(part[[*series, "__seg"]].iloc[0])
        return [(*key, machine.summary(part, int(key[-1]) * segment_rows))]

    return table.repartition(*series, "__seg").sortWithinPartitions(*series, "__seg", idx).mapInPandas(run, schema)


def _assumed(heads: DataFrame, summaries: DataFrame, axis: Axis, machine: Machine, segment_rows: int) -> DataFrame:
    """(series, __seg, __state) from each head (series, __seg, __state, __ahead) on, over the summaries after it."""
    series = list(axis.series)
    schema = T.StructType([*[heads.schema[c] for c in series], T.StructField("__seg", T.LongType()), T.StructField("__state", T.BinaryType())])
    none = F.lit(None).cast("binary")
    begin = heads.select(*series, F.col("__seg").alias("__head"), "__state", "__ahead")
    # A segment's summary leads to the state before the next one.
    passed = begin.drop("__state").join(summaries, series).where(
        (F.col("__seg") >= F.col("__head")) & (F.col("__seg") < F.col("__head") + F.col("__ahead") - 1)
    )
    chain = begin.select(*series, "__head", F.lit(None).cast("long").alias("__seg"), "__state", none.alias("__summary")).unionByName(
        passed.select(*series, "__head", "__seg", none.alias("__state"), "__summary")
    )
    dealt = chain.repartition(*series).sortWithinPartitions(*series, F.col("__seg").asc_nulls_first())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            out = []
            for *key, head, seg, given, summary in pdf.itertuples(index=False, name=None):
                if summary is None:
                    state = machine.thawed(bytes(given))
                    out.append((*key, head, bytes(given)))
                else:
                    state = machine.advance(state, bytes(summary), segment_rows)
                    out.append((*key, int(seg) + 1, machine.frozen(state)))
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    return dealt.mapInPandas(run, schema)


def _next(current: DataFrame, every: DataFrame, summaries: DataFrame | None, axis: Axis, machine: Machine, segment_rows: int) -> DataFrame:
    """What has to run next: (series, __seg, __state); nothing if every segment stands."""
    series = list(axis.series)
    w = Window.partitionBy(*series).orderBy("__seg")
    told = every.join(current, [*series, "__seg"], "left").withColumn("before", F.lag("end").over(w))
    wrong = (F.col("__seg") > 0) & (F.col("assumed").isNull() | (F.col("assumed") != F.col("before")))
    told = told.withColumn("wrong", wrong)
    if summaries is None:
        # A segment whose predecessor stands as far as is known runs again; what follows it may stand yet.
        heads = told.withColumn("lead", F.lag("wrong").over(w)).where(F.col("wrong") & ~F.coalesce("lead", F.lit(False)))
        return materialise(heads.select(*series, "__seg", F.col("before").alias("__state")), "todo")
    bad = told.where("wrong").groupBy(*series).agg(F.min(F.struct("__seg", "before", "run")).alias("h"))
    # After a round in which little stood less is guessed: twice the segments that stood.
    latest = told.groupBy(*series).agg(F.max("run").alias("latest"))
    stood = told.join(bad, series).join(latest, series).where((F.col("__seg") < F.col("h.__seg")) & (F.col("run") == F.col("latest"))).groupBy(*series).agg(F.count("*").alias("stood"))
    ahead = F.least(F.lit(AHEAD), F.greatest(F.lit(LEAST_AHEAD), 2 * F.coalesce("stood", F.lit(0)))).cast("int")
    heads = bad.join(stood, series, "left").select(*series, F.col("h.__seg").alias("__seg"), F.col("h.before").alias("__state"), ahead.alias("__ahead"))
    todo = _assumed(materialise(heads, "heads"), summaries, axis, machine, segment_rows).join(every, [*series, "__seg"], "left_semi")
    same = current.select(*series, "__seg", F.col("assumed").alias("__state"))
    return materialise(todo.join(same, [*series, "__seg", "__state"], "left_anti"), "todo")
