"""Row validation, causal imputation, outlier flags and normalisation against frozen statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import Axis
from tidegauge.operators.profile import stat

# Default tolerances.
RANGE_SIGMA, IQR_MULTIPLIER, ZSCORE_LIMIT = 6.0, 3.0, 4.0


def range_bounds(column: str, k: float = RANGE_SIGMA) -> tuple[Column, Column]:
    """Baseline mean +/- k sigma, widened to the observed baseline range."""
    m, s = stat(column, "mean"), F.lit(float(k)) * stat(column, "std")
    return F.least(m - s, stat(column, "minimum")), F.greatest(m + s, stat(column, "maximum"))


def outlier_bounds(column: str, method: str = "iqr", k: float | None = None) -> tuple[Column, Column]:
    if method == "iqr":
        step = F.lit(float(IQR_MULTIPLIER if k is None else k)) * (stat(column, "q3") - stat(column, "q1"))
        return stat(column, "q1") - step, stat(column, "q3") + step
    if method == "zscore":
        step = F.lit(float(ZSCORE_LIMIT if k is None else k)) * stat(column, "std")
        return stat(column, "mean") - step, stat(column, "mean") + step
    raise ValueError(f"unknown outlier method {method!r}")


def outside(column: str, bounds: tuple[Column, Column]) -> Column:
    """Out-of-bounds flag; a missing value is never out of bounds."""
    x = F.col(column)
    return F.coalesce((x < bounds[0]) | (x > bounds[1]), F.lit(False))


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(or_, flags) if flags else F.lit(False)


def range_check(df: DataFrame, columns: Sequence[str], k: float = RANGE_SIGMA) -> DataFrame:
    """Flag rows outside the plausible range per column and overall; rows are kept."""
    flagged = df.withColumns({f"{c}__range": outside(c, range_bounds(c, k)) for c in columns})
    return flagged.withColumn("range_violation", any_of([F.col(f"{c}__range") for c in columns]))


def outlier_flags(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", k: float | None = None
) -> DataFrame:
    """Flag values beyond frozen bounds per column and overall; rows are kept."""
    flagged = df.withColumns({f"{c}__outlier": outside(c, outlier_bounds(c, method, k)) for c in columns})
    return flagged.withColumn("outlier", any_of([F.col(f"{c}__outlier") for c in columns]))


def outlier_clip(df: DataFrame, columns: Sequence[str], method: str = "iqr", k: float | None = None) -> DataFrame:
    """Pull values back to the frozen bounds (this attenuates drift; off by default)."""

    def held(c: str) -> Column:
        lo, hi = outlier_bounds(c, method, k)
        return F.when(F.col(c).isNotNull(), F.greatest(lo, F.least(hi, F.col(c))))

    return df.withColumns({c: held(c) for c in columns})


def degenerate_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr") -> DataFrame:
    """Per column: is its band of zero width, and its flag count; plus the row counts.

    `n_rows_flagged` counts rows with any flag, `n_rows_flagged_excluding` the same without
    the zero-width columns.
    """
    bounds = {c: outlier_bounds(c, method) for c in columns}
    flags = {c: outside(c, b) for c, b in bounds.items()}
    flat = {c: (b[1] - b[0]) <= 0 for c, b in bounds.items()}
    useful = any_of([flags[c] & ~flat[c] for c in columns])
    counted = df.agg(
        F.count_if(any_of(list(flags.values()))).alias("n_rows_flagged"),
        F.count_if(useful).alias("n_rows_flagged_excluding"),
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.bool_or(flat[c]).alias("degenerate"),
                F.count_if(flags[c]).alias("n_flagged"),
            ).alias(f"__c{j}")
            for j, c in enumerate(columns)
        ],
    )
    per_column = F.inline(F.array(*[F.col(f"__c{j}") for j in range(len(columns))]))
    return counted.select("n_rows_flagged", "n_rows_flagged_excluding", per_column)


def forward_fill(
    df: DataFrame, axis: Axis, columns: Sequence[str], limit: int, block: str | None = "block_id"
) -> DataFrame:
    """Fill from the past only: at most `limit` rows, never across a block boundary.

    Adds `filled` (some hole of the row was filled) and `unfilled` (some hole remains).
    """
    tag = F.col(block) if block else F.lit(0)
    reach = {
        f"__src_{c}": (
            lambda w, c=c: F.last(
                F.when(F.col(c).isNotNull(), F.struct(tag.alias("b"), F.col(c).alias("v"))),
                ignorenulls=True,
            ).over(w.rowsBetween(-limit, 0))
        )
        for c in columns
    }
    out = axis.bounded(df, reach, back=limit)
    value = {c: F.when(F.col(f"__src_{c}.b") == tag, F.col(f"__src_{c}.v")) for c in columns}
    holes = {c: F.col(c).isNull() for c in columns}
    return out.select(
        *[F.col(c) for c in df.columns if c not in columns],
        *[v.alias(c) for c, v in value.items()],
        any_of([holes[c] & value[c].isNotNull() for c in columns]).alias("filled"),
        any_of([value[c].isNull() for c in columns]).alias("unfilled"),
    )


def trailing(
    df: DataFrame, axis: Axis, columns: Mapping[str, str], width: int, kind: str = "mean", block: str | None = None
) -> DataFrame:
    """Backward-looking mean or median over the last `width` rows of the same block."""
    if width < 1:
        raise ValueError("width must be at least 1")
    if kind not in ("mean", "median"):
        raise ValueError(f"unknown smoothing {kind!r}")

    def smooth(source: str):
        def build(w):
            # Narrowing the partition to the block keeps the frame inside it.
            spec = w.partitionBy(*axis.series, "__chunk", block).orderBy(axis.idx) if block else w
            frame = spec.rowsBetween(-(width - 1), 0)
            if kind == "mean":
                return F.avg(source).over(frame)
            return F.percentile(source, 0.5).over(frame)

        return build

    return axis.bounded(df, {name: smooth(source) for name, source in columns.items()}, back=width - 1)


def normalize_frozen(column: str, epsilon: float = 1e-8) -> Column:
    """z-score against the frozen baseline: an injected shift stays visible."""
    return (F.col(column) - stat(column, "mean")) / F.greatest(stat(column, "std"), F.lit(epsilon))


def normalize_minmax(column: str, epsilon: float = 1e-8) -> Column:
    lo, hi = stat(column, "minimum"), stat(column, "maximum")
    return (F.col(column) - lo) / F.greatest(hi - lo, F.lit(epsilon))


def normalize_running(df: DataFrame, axis: Axis, columns: Sequence[str], epsilon: float = 1e-8) -> DataFrame:
    """z-score against cumulative statistics seeded with the baseline; adds <column>__run.

    Needs the frozen statistics on the row. Missing values neither count nor contribute.
    """
    sums = {}
    for c in columns:
        sums[f"__n_{c}"] = F.col(c).isNotNull().cast("double")
        sums[f"__s_{c}"] = F.col(c).cast("double")
        sums[f"__q_{c}"] = F.col(c).cast("double") * F.col(c)
    out = axis.running(df, sums=sums)

    def z(c: str) -> Column:
        n0, m0, s0 = F.col("n_rows").cast("double"), stat(c, "mean"), stat(c, "std")
        n = n0 + F.col(f"__n_{c}")
        mean = (n0 * m0 + F.col(f"__s_{c}")) / n
        var = (n0 * (s0 * s0 + m0 * m0) + F.col(f"__q_{c}")) / n - mean * mean
        return (F.col(c) - mean) / F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(epsilon))

    return out.select(*df.columns, *[z(c).alias(f"{c}__run") for c in columns])


def baseline_tail(df: DataFrame, axis: Axis, columns: Sequence[str], width: int) -> DataFrame:
    """Last `width` baseline rows of every series, indexed -width..-1 in order."""
    ends = df.groupBy(*axis.series).agg((F.max(axis.idx) + 1).alias("__n"))
    back = (F.col(axis.idx) - F.col("__n")).alias(axis.idx)
    return (
        df.join(ends, list(axis.series))
        .where(F.col(axis.idx) >= F.col("__n") - width)
        .select(*axis.series, back, *columns)
    )


def normalize_rolling(
    df: DataFrame, axis: Axis, tail: DataFrame, columns: Sequence[str], width: int, epsilon: float = 1e-8
) -> DataFrame:
    """z-score against the last `width` rows, seeded by the baseline tail; adds <column>__roll.

    The tail is unioned in with negative row numbers and dropped after the frame is computed.
    """
    if width < 2:
        raise ValueError("width must be at least 2")
    joined = df.unionByName(tail, allowMissingColumns=True)
    frame = lambda w: w.rowsBetween(-(width - 1), 0)
    exprs = {}
    for c in columns:
        exprs[f"__m_{c}"] = lambda w, c=c: F.avg(c).over(frame(w))
        exprs[f"__d_{c}"] = lambda w, c=c: F.stddev_pop(c).over(frame(w))
    out = axis.bounded(joined, exprs, back=width - 1).where(F.col(axis.idx) >= 0)
    z = lambda c: (F.col(c) - F.col(f"__m_{c}")) / F.greatest(F.col(f"__d_{c}"), F.lit(epsilon))
    return out.select(*df.columns, *[z(c).alias(f"{c}__roll") for c in columns])


def row_validity(unfilled: Column, normalised: Sequence[Column]) -> Column:
    """Complete after imputation and normalisation; outlier and range flags do not matter."""
    return ~unfilled & reduce(and_, [c.isNotNull() for c in normalised])


def quality_summary(df: DataFrame, channel_flags: Mapping[str, Column], top: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Totals per row flag, and the `top` channels by flag count as 'channel:count' strings."""
    totals = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(f)).alias(f"n_{f}") for f in QUALITY_FLAGS],
        F.array(
            *[
                F.struct((-F.count_if(c)).alias("k"), F.lit(name).alias("name"))
                for name, c in channel_flags.items()
            ]
        ).alias("__channels"),
    )
    ranked = F.slice(F.array_sort(F.filter("__channels", lambda s: s["k"] < 0)), 1, top)
    label = F.transform(ranked, lambda s: F.concat_ws(":", s["name"], (-s["k"]).cast("string")))
    return totals.withColumn("top_channels", F.array_join(label, "|")).drop("__channels")


# Row flags of a quality report, in log order.
QUALITY_FLAGS = ("valid", "validation_failed", "range_violation", "outlier", "filled", "unfilled")


def top_offenders(df: DataFrame, channel_flags: Mapping[str, Column], k: int = 5) -> DataFrame:
    """Channels with the most flagged rows: one pre-aggregated pass, then k rows."""
    counted = df.agg(
        F.array(
            *[
                F.struct(F.lit(n).alias("channel"), F.count_if(c).alias("n_flagged"))
                for n, c in channel_flags.items()
            ]
        ).alias("__channels")
    )
    return (
        counted.select(F.inline("__channels"))
        .where(F.col("n_flagged") > 0)
        .orderBy(F.desc("n_flagged"), "channel")
        .limit(k)
    )
