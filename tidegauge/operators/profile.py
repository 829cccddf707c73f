"""Baseline profiles, frozen statistics and exact quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import materialise

#: Numbers in the sketches of all groups up to which they are joined map-side.
BROADCAST_MARKS = 2_000_000


def unpivot(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """One row per (row, column): `by` columns, the column's name and its value as double."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "column", value)


def profile_columns(df: DataFrame, columns: Sequence[str], max_discrete: int = 10, exact: bool = True) -> DataFrame:
    """Per column: distinct count, mean, population std, min, max, kind.

    The exact distinct count shuffles every distinct (column, value) pair. On wide tables of
    continuous channels `exact=False` sketches it instead, in the one pass of the moments; a
    count as small as `max_discrete` comes out of the sketch unchanged.
    """
    if exact:
        out = unpivot(df, columns).groupBy("column").agg(
            F.count_distinct("value").alias("n_unique"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
        )
    else:
        cells = [
            F.struct(
                F.lit(c).alias("column"),
                F.approx_count_distinct(F.col(c).cast("double"), 0.01).alias("n_unique"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.stddev_pop(F.col(c).cast("double")).alias("std"),
                F.min(F.col(c).cast("double")).alias("minimum"),
                F.max(F.col(c).cast("double")).alias("maximum"),
            )
            for c in columns
        ]
        out = df.agg(F.array(*cells).alias("__cells")).select(F.inline("__cells"))
    return out.withColumn("is_discrete", F.col("n_unique") <= max_discrete).withColumn(
        "zero_variance", F.col("n_unique") <= 1
    )


def baseline_profile(df: DataFrame, columns: Sequence[str], role: str = "role", baseline: str = "baseline_train", **kw) -> DataFrame:
    """Profile of the baseline role alone; other roles never contribute."""
    return profile_columns(df.where(F.col(role) == baseline), columns, **kw)


def classify_columns(
    profile: DataFrame,
    max_discrete: int = 10,
    continuous: Sequence[str] = (),
    discrete: Sequence[str] = (),
) -> DataFrame:
    """Kind of every column: by cardinality unless an override names it."""
    overlap = set(continuous) & set(discrete)
    if overlap:
        raise ValueError(f"columns declared both continuous and discrete: {sorted(overlap)}")
    name = F.col("column")
    kind = (
        F.when(name.isin(*continuous), F.lit("continuous"))
        .when(name.isin(*discrete), F.lit("discrete"))
        .when(F.col("n_unique") <= max_discrete, F.lit("discrete"))
        .otherwise(F.lit("continuous"))
    )
    source = F.when(name.isin(*continuous, *discrete), F.lit("override")).otherwise(F.lit("cardinality"))
    return profile.select("column", "n_unique", kind.alias("kind"), source.alias("decided_by"))


def zero_variance_report(profile: DataFrame, declared: Sequence[str] = ()) -> DataFrame:
    """Columns measured constant, against those declared constant."""
    measured = F.col("n_unique") <= 1
    was_declared = F.col("column").isin(*declared) if declared else F.lit(False)
    return profile.where(measured | was_declared).select(
        "column",
        measured.alias("measured"),
        was_declared.alias("declared"),
        F.when(measured & ~was_declared, F.lit("undeclared"))
        .when(~measured & was_declared, F.lit("varies"))
        .otherwise(F.lit("agrees"))
        .alias("status"),
    )


def exclude_siblings(profile: DataFrame, target: str, pairs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Feature columns for a target: the target and its paired channels are left out."""
    banned = sorted({target, *pairs.get(target, ())})
    return profile.where(~F.col("column").isin(*banned)).select("column", "n_unique")


def resolve_target(profile: DataFrame, target: str | None, task: str | None) -> str:
    """The target's name, once it exists and its kind suits the task."""
    if target is None or task not in ("classification", "regression"):
        raise ValueError("target or task is unresolved")
    row = profile.where(F.col("column") == target).select("is_discrete").first()
    if row is None:
        raise ValueError(f"target {target!r} is not in the baseline profile")
    if task == "classification" and not row.is_discrete:
        raise ValueError(f"target {target!r} is continuous; classification needs a discrete one")
    if task == "regression" and row.is_discrete:
        raise ValueError(f"target {target!r} is discrete; regression needs a continuous one")
    return target


def top_variance(profile: DataFrame, k: int, continuous_only: bool = True) -> DataFrame:
    """The k columns of largest baseline std, ties by name; constant columns have no scale."""
    pool = profile.where(F.col("n_unique") > 1)
    if continuous_only:
        pool = pool.where(~F.col("is_discrete"))
    return pool.orderBy(F.desc("std"), "column").limit(k).select("column", "std")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 100_000,
    broadcast_marks: int = BROADCAST_MARKS,
) -> DataFrame:
    """Linearly interpolated quantiles, one row per (by, column), columns q0, q1, ...

    Spark's exact `percentile` keeps every distinct value of a group in one buffer. Here a
    mergeable sketch first brackets each rank; a second pass counts the rows below the
    bracket (map-side) and keeps exact counts only for values inside it, about 4/accuracy of
    the group: at the default, a group of 10^11 rows leaves four million for its last sort.
    The result is exact because the sketch's rank error is at most 1/accuracy. The sketches of
    all groups are written, and joined map-side up to `broadcast_marks` numbers in all.
    """
    slack = 2.0 / accuracy
    marks = [m for p in probs for m in (max(0.0, p - slack), min(1.0, p + slack))]
    # Values keep the position of their column, so no name is repeated per row.
    values = [F.col(c).cast("double") for c in columns]
    sketch = df.groupBy(*by).agg(
        *[
            agg
            for j, v in enumerate(values)
            for agg in (
                F.count(v).alias(f"__n{j}"),
                F.percentile_approx(v, [float(m) for m in marks], accuracy).alias(f"__m{j}"),
            )
        ]
    )
    rows = df.select(*by, *[v.alias(f"__v{j}") for j, v in enumerate(values)])
    if by:
        # A few large groups must not be sorted by key, one in a task: their rows meet the sketch where they are.
        sketch = materialise(sketch, "sketch")
        small = sketch.count() * len(marks) * len(columns) <= broadcast_marks
        joined = rows.join(F.broadcast(sketch) if small else sketch, list(by))
    else:
        joined = rows.crossJoin(F.broadcast(sketch))  # an ungrouped aggregate: exactly one row
    cells = [
        F.struct(
            F.lit(j).alias("c"),
            F.lit(i).alias("p"),
            F.col(f"__n{j}").alias("n"),
            F.when(F.col(f"__v{j}") < F.col(f"__m{j}")[2 * i], F.lit(-1))
            .when(F.col(f"__v{j}") > F.col(f"__m{j}")[2 * i + 1], F.lit(1))
            .otherwise(F.lit(0))
            .alias("side"),
            F.col(f"__v{j}").alias("v"),
        )
        for j in range(len(columns))
        for i in range(len(probs))
    ]
    # Rows outside the bracket collapse to one group per side. Its nearest value is kept: on
    # few rows it may be the neighbour of the rank, as (n - 1) * p and n * p differ by a row.
    counted = (
        joined.select(*by, F.inline(F.array(*cells)))
        .where(F.col("v").isNotNull())
        .groupBy(*by, "c", "p", "n", "side", F.when(F.col("side") == 0, F.col("v")).alias("inside"))
        .agg(
            F.count("*").alias("k"),
            F.when(F.col("side") < 0, F.max("v")).otherwise(F.min("v")).alias("v"),
        )
    )
    upto = Window.partitionBy(*by, "c", "p").orderBy("side", "inside").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("p") + 1)
    rank = (F.col("n") - 1) * prob
    lower = F.min(F.when(F.col("cum") > F.floor("rank"), F.col("v")))
    upper = F.min(F.when(F.col("cum") > F.ceil("rank"), F.col("v")))
    found = (
        counted.withColumn("cum", F.sum("k").over(upto))
        .withColumn("rank", rank)
        .groupBy(*by, "c", "p")
        .agg(lower.alias("lo"), upper.alias("hi"), F.first("rank").alias("rank"))
        .withColumn("q", F.col("lo") + (F.col("rank") - F.floor("rank")) * (F.col("hi") - F.col("lo")))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return (
        found.groupBy(*by, "c")
        .agg(*[F.max(F.when(F.col("p") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))])
        .select(*by, F.element_at(names, F.col("c") + 1).alias("column"), *[f"q{i}" for i in range(len(probs))])
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One wide row: n_rows and <column>__mean, __std, __minimum, __maximum, in one pass."""
    return df.select([F.col(c).cast("double").alias(c) for c in columns]).agg(
        F.count("*").alias("n_rows"),
        *[
            agg.alias(f"{c}__{name}")
            for c in columns
            for name, agg in (
                ("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("minimum", F.min(c)), ("maximum", F.max(c)),
            )
        ],
    )


def fit_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frozen statistics, one row per column: n, mean, population std, min, max, q1, q3."""
    names = ("mean", "std", "minimum", "maximum")
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").alias(n) for n in names]) for c in columns]
    long = moments(df, columns).select("n_rows", F.inline(F.array(*cells)))
    quart = exact_quantiles(df, columns, [0.25, 0.75]).select(
        "column", F.col("q0").alias("q1"), F.col("q1").alias("q3")
    )
    return long.join(quart, "column")


def wide_statistics(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: <column>__mean, __std, __minimum, __maximum, __q1, __q3 and n_rows."""
    pick = lambda c, s: F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{c}__{s}")
    return stats.agg(
        F.max("n_rows").alias("n_rows"),
        *[pick(c, s) for c in columns for s in ("mean", "std", "minimum", "maximum", "q1", "q3")],
    )


def apply_frozen(df: DataFrame, wide: DataFrame) -> DataFrame:
    """Put the one frozen row beside every row of the stream."""
    return df.crossJoin(F.broadcast(wide))  # an ungrouped aggregate: exactly one row


def stat(column: str, name: str) -> Column:
    return F.col(f"{column}__{name}")
