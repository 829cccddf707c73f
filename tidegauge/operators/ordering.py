"""Causal order and ordered scans that never put a whole series into one task.

A window partitioned by series alone hands one task everything a hot series holds. Here a
series is ordered by a range sort (balanced by rows, whatever the key skew), numbered from
per-partition counts, and from then on cut into chunks of `chunk_rows` consecutive rows.
Every ordered operator works on (series, chunk):

* bounded frames copy the few rows they need from the neighbouring chunk (`Axis.bounded`);
* unbounded frames add a carry computed from one summary row per chunk (`Axis.running`);
* exponential smoothing needs only the previous block once alpha**block vanishes (`Axis.ema`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.session import materialise

ROWS_PER_CHUNK = 1 << 20
BROADCAST_ROWS = 500_000
#: Rows of a table that are taken through many stages at once, in whole series.
WAVE_ROWS = 1 << 20
_CHUNK, _OWN = "__chunk", "__own_chunk"
SPREAD = (_CHUNK, _OWN)


@dataclass(frozen=True)
class Axis:
    """Names the series key and the dense row index that order a DataFrame."""

    series: tuple[str, ...]
    idx: str = "row_idx"
    chunk_rows: int = ROWS_PER_CHUNK

    def chunk(self) -> Column:
        return F.floor(F.col(self.idx) / F.lit(self.chunk_rows)).cast("long")

    def bounded(
        self,
        df: DataFrame,
        exprs: Mapping[str, Callable[[WindowSpec], Column]],
        back: int = 0,
        ahead: int = 0,
    ) -> DataFrame:
        """Add columns whose frames reach at most `back` rows back and `ahead` rows on.

        Each expression receives the window ordered by index and sets its own frame.
        """
        if max(back, ahead) > self.chunk_rows:
            raise ValueError(f"frame of {max(back, ahead)} rows exceeds chunk_rows={self.chunk_rows}")
        own, pos = self.chunk(), F.pmod(F.col(self.idx), F.lit(self.chunk_rows))
        homes = [own]
        if back:
            homes.append(F.when(pos >= self.chunk_rows - back, own + 1))
        if ahead:
            homes.append(F.when(pos < ahead, own - 1))
        if len(homes) == 1:
            spread = df.withColumn(_CHUNK, own)
        else:
            spread = df.withColumn(_OWN, own).withColumn(
                _CHUNK, F.explode(F.array_compact(F.array(*homes)))
            )
        w = Window.partitionBy(*self.series, _CHUNK).orderBy(self.idx)
        out = spread.select("*", *[build(w).alias(name) for name, build in exprs.items()])
        if len(homes) > 1:
            out = out.where(F.col(_CHUNK) == F.col(_OWN)).drop(_OWN)
        return out.drop(_CHUNK)

    def running(
        self,
        df: DataFrame,
        sums: Mapping[str, Column] | None = None,
        lasts: Mapping[str, Column] | None = None,
        maxima: Mapping[str, Column] | None = None,
        before: bool = False,
    ) -> DataFrame:
        """Add inclusive running sums, last non-null values and maxima of the series so far.

        With `before`, also each value as of the previous row, as <name>__before.

        The source is read twice: once for the per-chunk summaries (pre-aggregated before
        their small shuffle), once for the rows. Materialise an expensive source first.
        """
        plan = [("sum", n, c) for n, c in (sums or {}).items()]
        plan += [("last", n, c) for n, c in (lasts or {}).items()]
        plan += [("max", n, c) for n, c in (maxima or {}).items()]
        d = df.select(
            "*", self.chunk().alias(_CHUNK), *[c.alias(f"__in_{n}") for _, n, c in plan]
        )
        keys = [*self.series, _CHUNK]

        def total(kind: str, name: str) -> Column:
            c = F.col(f"__in_{name}")
            if kind == "last":
                return F.max_by(c, F.when(c.isNotNull(), F.col(self.idx)))
            return F.sum(c) if kind == "sum" else F.max(c)

        chunks = d.groupBy(*keys).agg(*[total(k, n).alias(f"__tot_{n}") for k, n, _ in plan])
        chunks_before = Window.partitionBy(*self.series).orderBy(_CHUNK).rowsBetween(
            Window.unboundedPreceding, -1
        )
        in_chunk = Window.partitionBy(*keys).orderBy(self.idx)
        upto = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows_before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)

        def over(kind: str, c: Column, w: WindowSpec) -> Column:
            if kind == "last":
                return F.last(c, ignorenulls=True).over(w)
            return (F.sum(c) if kind == "sum" else F.max(c)).over(w)

        carry = chunks.select(
            *keys, *[over(k, F.col(f"__tot_{n}"), chunks_before).alias(f"__carry_{n}") for k, n, _ in plan]
        )
        out = d.join(carry, keys, "left")

        def merged(kind: str, name: str, w: WindowSpec) -> Column:
            local, c = over(kind, F.col(f"__in_{name}"), w), F.col(f"__carry_{name}")
            if kind == "sum":
                return F.coalesce(local, F.lit(0)) + F.coalesce(c, F.lit(0))
            return F.coalesce(local, c) if kind == "last" else F.greatest(local, c)

        cols = [merged(k, n, upto).alias(n) for k, n, _ in plan]
        if before:
            cols += [merged(k, n, rows_before).alias(f"{n}__before") for k, n, _ in plan]
        return out.select(*df.columns, *cols)

    def _block(self, alpha: float, back: int) -> tuple[int, int]:
        """Rows of a block of smoothing, and rows that a chunk needs of the one before."""
        if not 0.0 <= alpha < 1.0:
            raise ValueError(f"alpha must be in [0, 1), got {alpha}")
        block = 1 if alpha == 0.0 else max(1, math.ceil(100.0 * math.log(10.0) / -math.log(alpha)))
        halo = 2 * block + back
        if halo > self.chunk_rows:
            raise ValueError(f"alpha={alpha} needs chunk_rows >= {halo}")
        return block, halo

    def _spread(self, df: DataFrame, alpha: float, back: int) -> DataFrame:
        near_end = F.pmod(F.col(self.idx), F.lit(self.chunk_rows)) >= self.chunk_rows - self._block(alpha, back)[1]
        own = self.chunk()
        return df.withColumn(_OWN, own).withColumn(_CHUNK, F.explode(F.array_compact(F.array(own, F.when(near_end, own + 1)))))

    def spread(self, df: DataFrame, alpha: float, by: Sequence[str], back: int = 0) -> DataFrame:
        """Rows dealt for `emas` by some of the series' columns, to be multiplied into series afterwards.

        Where every row is replayed in many runs, the rows move once and not once a run. The result holds the columns
        SPREAD, which have to stay until it is smoothed.
        """
        # A number: adaptive execution would join partitions by what they hold before they are multiplied.
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self._spread(df, alpha, back).repartition(n, *by, _CHUNK)

    def ema(
        self, df: DataFrame, name: str, value: Column, alpha: float, initial: float | None = None
    ) -> DataFrame:
        """Add s(t) = alpha*s(t-1) + (1-alpha)*x(t); s starts at x(0), or at `initial`."""
        return self.emas(df, {name: (value, initial)}, alpha)

    def emas(
        self,
        df: DataFrame,
        values: Mapping[str, tuple[Column, float | None]],
        alpha: float,
        then: Mapping[str, Callable[[WindowSpec], Column]] | None = None,
        back: int = 0,
    ) -> DataFrame:
        """Several smoothed columns, and frames of up to `back` rows over them, in one shuffle.

        Rows are summed in blocks long enough that alpha**block <= 1e-100, so the end of the
        previous block carries everything a double can hold: no recursion, no second pass,
        and powers that stay far from overflow. Values must be present on every row, a null
        stops the job; smooth a sparse sequence over its own dense index.
        """
        block, _ = self._block(alpha, back)
        row = F.col(self.idx)
        valued = df.withColumns({f"__x_{n}": present(v.cast("double"), n) for n, (v, _) in values.items()})
        if _CHUNK not in df.columns:
            valued = self._spread(valued, alpha, back).repartition(*self.series, _CHUNK)
        spread = valued.withColumn("__block", F.floor(row / F.lit(block))).withColumn("__pos", F.pmod(row, F.lit(block)).cast("double"))
        a, pos = F.lit(float(alpha)), F.col("__pos")
        fade = F.pow(a, pos)  # 1 at the start of a block, also for alpha 0
        ordered = Window.partitionBy(*self.series, _CHUNK).orderBy(self.idx)
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        in_block = Window.partitionBy(*self.series, _CHUNK, "__block").orderBy(self.idx).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )

        def local(name: str, initial: float | None) -> Column:
            weight = F.lit(1.0 - alpha)
            if initial is None:
                weight = F.when(row == 0, F.lit(1.0)).otherwise(weight)
            return fade * F.sum(weight * F.col(f"__x_{name}") / fade).over(in_block)

        def whole(name: str, initial: float | None) -> Column:
            end = F.when(pos == block - 1, F.col(f"__l_{name}"))
            start = F.when(F.col("__block") == 0, F.lit(float(initial or 0.0)))
            before = F.coalesce(start, F.last(end, ignorenulls=True).over(earlier), F.lit(0.0))
            return F.col(f"__l_{name}") + a * fade * before

        out = spread.withColumns({f"__l_{n}": local(n, i) for n, (_, i) in values.items()})
        out = out.withColumns({n: whole(n, i) for n, (_, i) in values.items()})
        if then:
            out = out.withColumns({n: build(ordered) for n, build in then.items()})
        added = [*values, *(then or {})]
        kept = [c for c in df.columns if c not in (*added, _CHUNK, _OWN)]
        return out.where(F.col(_CHUNK) == F.col(_OWN)).select(*kept, *added)


def present(value: Column, name: str) -> Column:
    """The value; a null fails the job instead of counting as zero."""
    missing = F.raise_error(F.lit(f"{name}: a value is missing; fill it or smooth over a dense index")).cast("double")
    return F.when(value.isNull(), missing).otherwise(value)


def causal_order(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    idx: str = "row_idx",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Number the rows of each series 0..n-1 by `order`, nulls last.

    `order` should end in a unique column. The range sort balances partitions by row count
    even when one series, or one time stamp, holds most of the table. The sorted rows are
    written once; an index is the position in the partition plus the rows of the same series
    in earlier partitions. Those offsets are a small written table, one row per (series,
    partition). Its size is checked: up to `broadcast_rows` it joins map-side, so numbering
    costs no shuffle and no second copy of the data; with more series than that the numbered
    rows are written instead, so that the join is paid once.
    """
    keys = [F.col(c).asc_nulls_last() for c in (*series, *order)]
    placed = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__at", F.monotonically_increasing_id()),
        "ordered",
    )
    # monotonically_increasing_id: partition number in the upper bits, row position in the lower 33.
    at = placed.withColumn("__part", F.shiftright("__at", 33))
    spans = at.groupBy(*series, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*series).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        spans.select(
            *series,
            "__part",
            (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        ),
        "offsets",
    )
    small = offsets.count() <= broadcast_rows
    numbered = at.join(F.broadcast(offsets) if small else offsets, [*series, "__part"]).select(
        *df.columns, (F.col("__at") + F.col("__shift")).alias(idx)
    )
    return numbered if small else materialise(numbered, "numbered")


def gap_blocks(df: DataFrame, axis: Axis, ts: str, max_gap_s: float, name: str = "block_id") -> DataFrame:
    """Add a block number that rises by one at every step longer than `max_gap_s`."""
    step = axis.bounded(df, {"__prev": lambda w: F.lag(ts).over(w)}, back=1)
    jump = seconds_between(F.col("__prev"), F.col(ts)) > F.lit(float(max_gap_s))
    return axis.running(step, sums={name: F.coalesce(jump, F.lit(False)).cast("long")}).drop("__prev")


def seconds_between(earlier: Column, later: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1e6)


def order_flags(df: DataFrame, axis: Axis, ts: str, check_duplicates: bool = True) -> DataFrame:
    """Flag rows earlier than their predecessor, and repeats of a time stamp in the series.

    A table in causal order holds equal stamps side by side, so a repeat is a row whose
    stamp equals the previous one.
    """
    prev = F.col("__prev_ts")
    out = axis.bounded(df, {"__prev_ts": lambda w: F.lag(ts).over(w)}, back=1)
    dup = F.coalesce(F.col(ts) == prev, F.lit(False)) if check_duplicates else F.lit(False)
    return out.select(
        *df.columns,
        F.coalesce(F.col(ts) < prev, F.lit(False)).alias("is_back"),
        dup.alias("is_duplicate"),
    )


def arrival_order_flags(df: DataFrame, axis: Axis, ts: str) -> DataFrame:
    """Same two flags for rows indexed by arrival, where equal stamps may lie apart.

    Backward steps compare neighbours; a repeat is any row that is not the first arrival of
    its (series, stamp), found by a pre-aggregated minimum instead of a rank, so a stamp
    shared by a third of the rows costs one group row.
    """
    firsts = df.groupBy(*axis.series, ts).agg(F.min(axis.idx).alias("__first"))
    stepped = axis.bounded(df, {"__prev_ts": lambda w: F.lag(ts).over(w)}, back=1)
    return stepped.join(firsts, [*axis.series, ts], "left").select(
        *df.columns,
        F.coalesce(F.col(ts) < F.col("__prev_ts"), F.lit(False)).alias("is_back"),
        (F.col(axis.idx) > F.col("__first")).alias("is_duplicate"),
    )


def series_waves(df: DataFrame, column: str, rows: int = WAVE_ROWS) -> list[Column]:
    """Conditions that cut a table into ranges of `column`, each value whole: about `rows` rows each, or one value with more.

    Series are independent, so stages may run range by range, and what they write in between need not hold more than one range.
    Nulls are in the first range. To be filtered by; counted on one row per value.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    waves = counts.withColumn("__wave", F.floor(F.coalesce(before, F.lit(0)) / F.lit(rows))).groupBy("__wave")
    # The next range begins where this one ends, so every value is in one whatever lies between them.
    starts = [r[0] for r in waves.agg(F.min(column).alias("__start")).orderBy("__wave").select("__start").collect()]
    if len(starts) < 2:
        return [F.lit(True)]
    c = F.col(column)
    later = [c >= F.lit(start) for start in starts[1:]]
    ends = [c < F.lit(end) for end in starts[1:]]
    return [c.isNull() | ends[0], *[at_least & below for at_least, below in zip(later, ends[1:])], later[-1]]


def row_cap(df: DataFrame, idx: str, n: int) -> DataFrame:
    """First `n` rows of every series after ordering (a `limit` has no order)."""
    return df.where(F.col(idx) < n)


def recent_rows(df: DataFrame, axis: Axis, n: int) -> DataFrame:
    """Last `n` rows of every series, from the series' row counts instead of a sort."""
    ends = df.groupBy(*axis.series).agg(F.max(axis.idx).alias("__end"))
    return df.join(ends, list(axis.series)).where(F.col(axis.idx) > F.col("__end") - n).drop("__end")


def with_length(df: DataFrame, axis: Axis, name: str = "n_rows") -> DataFrame:
    """Add the row count of the series to every row."""
    return df.join(df.groupBy(*axis.series).agg(F.count("*").alias(name)), list(axis.series))
