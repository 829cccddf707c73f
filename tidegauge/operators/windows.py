"""Count-based sliding windows, their features, flags and labels.

Rows are first combined into panes of gcd(size, step) rows. Rows in causal order sit side by
side, so this combines before the shuffle; only pane summaries are then spread over the
size/step windows that contain them. No frame is evaluated per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import Axis

# Statistics per channel kind, in feature order.
CONTINUOUS_STATS = ("mean", "std", "min", "max", "last", "slope")
DISCRETE_STATS = ("mode", "n_changes")


def feature_names(
    continuous: Sequence[str],
    discrete: Sequence[str],
    continuous_stats: Sequence[str] = CONTINUOUS_STATS,
    discrete_stats: Sequence[str] = DISCRETE_STATS,
) -> list[str]:
    """Channel-major column order: every statistic of a channel before the next channel."""
    unknown = set(continuous_stats) - set(CONTINUOUS_STATS) | set(discrete_stats) - set(DISCRETE_STATS)
    if unknown:
        raise ValueError(f"unknown window statistics {sorted(unknown)}")
    return [f"{c}__{s}" for c in continuous for s in continuous_stats] + [
        f"{c}__{s}" for c in discrete for s in discrete_stats
    ]


def window_grid(lengths: DataFrame, size: int, step: int, n: str = "n_rows") -> DataFrame:
    """Every full window [start_index, end_index) of series with known row counts."""
    _check(size, step)
    last = F.floor((F.col(n) - size) / F.lit(step)) * step
    starts = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))
    return (
        lengths.where(F.col(n) >= size)
        .withColumn("start_index", F.explode(starts))
        .withColumn("end_index", F.col("start_index") + size)
    )


def _check(size: int, step: int) -> None:
    if size < 1 or step < 1:
        raise ValueError("size and step must be at least 1")


def _spread(panes: DataFrame, pane_rows: int, size: int, step: int) -> DataFrame:
    """One row per (pane, window start) for the windows that hold the whole pane."""
    first = F.col("pane") * pane_rows
    lo = F.greatest(F.lit(0), F.ceil((first + pane_rows - size) / F.lit(step)) * step).cast("long")
    hi = (F.floor(first / F.lit(step)) * step).cast("long")
    # sequence() rejects reversed bounds, which a step longer than the window produces.
    return (
        panes.withColumn("__lo", lo)
        .withColumn("__hi", hi)
        .where("__lo <= __hi")
        .withColumn("start_index", F.explode(F.sequence("__lo", "__hi", F.lit(step).cast("long"))))
        .drop("__lo", "__hi")
    )


def sliding_windows(
    df: DataFrame,
    axis: Axis,
    size: int,
    step: int,
    continuous: Sequence[str] = (),
    discrete: Sequence[str] = (),
    ts: str | None = None,
    block: str | None = None,
    valid: str | None = None,
    flags: Sequence[str] = (),
    label: str | None = None,
    positive: int = 1,
) -> DataFrame:
    """All candidate windows with metadata, features, flag counts and label summaries.

    Keep or drop windows with `emit`. Windows shorter than `size` are not candidates.
    """
    _check(size, step)
    g = math.gcd(size, step)
    idx, series = F.col(axis.idx), list(axis.series)
    d = df.withColumn("pane", F.floor(idx / F.lit(g)).cast("long")).withColumn("__at", F.pmod(idx, F.lit(g)))
    if discrete:
        prev = {f"__p_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in discrete}
        d = axis.bounded(d, prev, back=1)
    aggs: list[Column] = [F.count("*").alias("n")]
    both: list[Column] = [F.sum("n").alias("n_rows")]

    def carry(name: str, inner: Column, outer) -> None:
        aggs.append(inner.alias(name))
        both.append(outer(name).alias(name))

    if ts:
        carry("start_time", F.min(ts), F.min)
        carry("end_time", F.max(ts), F.max)
    if block:
        carry("__b0", F.min(block), F.min)
        carry("__b1", F.max(block), F.max)
    if valid:
        carry("__valid", F.count_if(F.col(valid)), F.sum)
    for f in flags:
        carry(f"n_{f}", F.count_if(F.col(f)), F.sum)
    if label:
        hit = F.col(label) == positive
        carry("n_positive", F.count_if(hit), F.sum)
        carry("label_first", F.min_by(label, axis.idx), lambda n: F.min_by(n, "pane"))
        carry("label_last", F.max_by(label, axis.idx), lambda n: F.max_by(n, "pane"))
    for c in continuous:
        carry(f"__n_{c}", F.count(c), F.sum)
        carry(f"__s_{c}", F.sum(c), F.sum)
        carry(f"__q_{c}", F.sum(F.col(c) * F.col(c)), F.sum)
        carry(f"{c}__min", F.min(c), F.min)
        carry(f"{c}__max", F.max(c), F.max)
        carry(f"{c}__last", F.max_by(c, axis.idx), lambda n: F.max_by(n, "pane"))
        # First moment about the window start: position in the pane plus the pane's offset.
        aggs.append(F.sum(F.col(c) * F.col("__at")).alias(f"__t_{c}"))
        both.append(
            F.sum(F.col(f"__t_{c}") + F.col(f"__s_{c}") * (F.col("pane") * g - F.col("start_index"))).alias(f"__t_{c}")
        )
    for c in discrete:
        moved = F.coalesce(F.col(c) != F.col(f"__p_{c}"), F.lit(False)).cast("long")
        carry(f"__k_{c}", F.sum(moved), F.sum)
        carry(f"__f_{c}", F.min_by(moved, axis.idx), lambda n: F.min_by(n, "pane"))
    panes = d.groupBy(*series, "pane").agg(*aggs)
    wins = _spread(panes, g, size, step).groupBy(*series, "start_index").agg(*both)
    wins = wins.where(F.col("n_rows") == size)

    n, centre = F.lit(float(size)), F.lit((size - 1) / 2.0)
    spread = F.lit(size * (size * size - 1) / 12.0)
    cols = [*series, F.col("start_index"), (F.col("start_index") + size).alias("end_index"), F.col("n_rows")]
    if ts:
        cols += [F.col("start_time"), F.col("end_time")]
    cols.append((F.col("__b0") == F.col("__b1") if block else F.lit(True)).alias("contiguous"))
    cols.append((F.col("__valid") / n if valid else F.lit(1.0)).alias("valid_fraction"))
    cols += [F.col(f"n_{f}") for f in flags]
    if label:
        cols += [F.col("n_positive"), F.col("label_first"), F.col("label_last")]
    for c in continuous:
        mean = F.col(f"__s_{c}") / n
        var = F.greatest(F.col(f"__q_{c}") / n - mean * mean, F.lit(0.0))
        slope = (F.col(f"__t_{c}") - centre * F.col(f"__s_{c}")) / spread if size > 1 else F.lit(0.0)
        # A hole poisons the statistics that divide by the window size.
        by_name = {s: F.when(F.col(f"__n_{c}") == size, x) for s, x in {"mean": mean, "std": F.sqrt(var), "slope": slope}.items()}
        cols += [by_name.get(s, F.col(f"{c}__{s}")).alias(f"{c}__{s}") for s in CONTINUOUS_STATS]
    # A change into the window's first row happened before the window.
    cols += [(F.col(f"__k_{c}") - F.col(f"__f_{c}")).alias(f"{c}__n_changes") for c in discrete]
    out = wins.select(*cols)
    modes = [(c, f"{c}__mode") for c in discrete] + ([(label, "label_majority")] if label else [])
    for c, name in modes:
        out = out.join(window_mode(df, axis, c, size, step, name), [*series, "start_index"], "left")
    return out


def window_mode(df: DataFrame, axis: Axis, column: str, size: int, step: int, name: str) -> DataFrame:
    """Most frequent value per window, the smallest among equals."""
    g = math.gcd(size, step)
    counts = (
        df.withColumn("pane", F.floor(F.col(axis.idx) / F.lit(g)).cast("long"))
        .groupBy(*axis.series, "pane", F.col(column).alias("__v"))
        .agg(F.count("*").alias("__k"))
    )
    per_window = (
        _spread(counts, g, size, step).groupBy(*axis.series, "start_index", "__v").agg(F.sum("__k").alias("__k"))
    )
    best = F.min(F.struct((-F.col("__k")).alias("k"), F.col("__v").alias("v")))
    return per_window.groupBy(*axis.series, "start_index").agg(best.alias("__best")).select(
        *axis.series, "start_index", F.col("__best.v").alias(name)
    )


def emit(
    windows: DataFrame, axis: Axis, step: int, require_contiguous: bool = True, min_valid_fraction: float = 0.0
) -> DataFrame:
    """Keep the windows that pass and number them 0.. within the series."""
    passed = windows.withColumn("__no", F.floor(F.col("start_index") / F.lit(step)).cast("long"))
    ok = F.col("valid_fraction") >= min_valid_fraction
    if require_contiguous:
        ok = ok & F.col("contiguous")
    grid = Axis(axis.series, "__no", axis.chunk_rows)
    numbered = grid.running(passed, sums={"__id": ok.cast("long")})
    return numbered.where(ok).withColumn("window_id", F.col("__id") - 1).drop("__no", "__id")


def window_stats(
    windows: DataFrame, lengths: DataFrame, axis: Axis, size: int, step: int,
    require_contiguous: bool = True, min_valid_fraction: float = 0.0,
) -> DataFrame:
    """Per series: candidates, emitted, skipped by cause, rows after the last candidate."""
    apart = ~F.col("contiguous") if require_contiguous else F.lit(False)
    poor = ~apart & (F.col("valid_fraction") < min_valid_fraction)
    counted = windows.groupBy(*axis.series).agg(
        F.count("*").alias("n_candidate"),
        F.count_if(~apart & ~poor).alias("n_emitted"),
        F.count_if(apart).alias("n_skipped_noncontiguous"),
        F.count_if(poor).alias("n_skipped_invalid"),
        F.max("end_index").alias("__covered"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return lengths.join(counted, list(axis.series), "left").select(
        *axis.series,
        F.col("n_rows").alias("n_rows_available"),
        *[zero(c) for c in ("n_candidate", "n_emitted", "n_skipped_noncontiguous", "n_skipped_invalid")],
        (F.col("n_rows") - F.coalesce(F.col("__covered"), F.lit(0))).alias("trailing_rows_dropped"),
    )


def interleaved_events(df: DataFrame, emitted: DataFrame, axis: Axis) -> DataFrame:
    """Samples and the windows they complete, numbered in arrival order per series.

    A window arrives right after the sample that completes it.
    """
    ends = emitted.select(*axis.series, (F.col("end_index") - 1).alias(axis.idx), "window_id", "start_index")
    rows = df.select(*axis.series, axis.idx).join(ends, [*axis.series, axis.idx], "left")
    done = axis.running(rows, sums={"__done": F.col("window_id").isNotNull().cast("long")})
    sample = F.struct(
        (F.col(axis.idx) + F.col("__done") - F.col("window_id").isNotNull().cast("long")).alias("arrival"),
        F.lit("sample").alias("kind"),
        F.lit(None).cast("long").alias("window_id"),
    )
    window = F.when(
        F.col("window_id").isNotNull(),
        F.struct(
            (F.col(axis.idx) + F.col("__done")).alias("arrival"), F.lit("window").alias("kind"), F.col("window_id")
        ),
    )
    return done.select(*axis.series, axis.idx, F.inline(F.array_compact(F.array(sample, window))))


def window_label(mode: str, positive: int = 1) -> Column:
    """Label of a window from the summaries `sliding_windows` adds."""
    if mode == "any_positive":
        return F.when(F.col("n_positive") > 0, F.lit(positive)).otherwise(F.col("label_first"))
    if mode == "majority":
        return F.col("label_majority")
    if mode == "last":
        return F.col("label_last")
    raise ValueError(f"unknown label aggregation {mode!r}")


def representative_window(df: DataFrame, axis: Axis, label: str, size: int, minimum: int) -> DataFrame:
    """Earliest start per series whose two halves each hold at least `minimum` positives.

    Consults labels, so it belongs to evaluation only. With a running count of positives,
    both halves are differences of three rows, so no frame of `size` rows is evaluated per
    row. Series without such a window give no row.
    """
    half = size // 2
    counted = axis.running(
        df.select(*axis.series, axis.idx, label), sums={"__c": (F.col(label) == 1).cast("long")}
    )
    at = lambda rows: lambda w: F.lead("__c", rows - 1).over(w)
    ends = {"__c2": at(size)} if half == 0 else {"__c1": at(half), "__c2": at(size)}
    found = axis.bounded(counted, ends, ahead=size)
    before = F.col("__c") - (F.col(label) == 1).cast("long")
    middle = F.col("__c1") if half else before
    first, second = middle - before, F.col("__c2") - middle
    return (
        found.where((first >= minimum) & (second >= minimum))
        .groupBy(*axis.series)
        .agg(
            F.min(axis.idx).alias("start_index"),
            F.min_by(first, axis.idx).alias("first_half_positives"),
            F.min_by(second, axis.idx).alias("second_half_positives"),
        )
    )
