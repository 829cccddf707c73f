"""Controlled drift as a column transform over the inference role."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.draws import normal, uniform
from tidegauge.operators.profile import stat

# Accepted names.
SCENARIOS = ("none", "sudden", "gradual", "recurring", "stress")
MECHANISMS = ("offset", "scale", "noise", "correlation")
UNITS = ("baseline_sigma", "absolute", "relative")
SELECTIONS = ("top_variance", "random", "all_continuous")


def position(fraction: float, n: Column) -> Column:
    """Row index of a fraction of the series, rounding halves to even."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction {fraction} outside [0, 1]")
    return F.bround(F.lit(float(fraction)) * n).cast("long")


def schedule(
    scenario: str,
    magnitude: float,
    idx: Column,
    n: Column,
    start_fraction: float = 0.5,
    end_fraction: float | None = None,
    duration_fraction: float = 0.1,
    period_fraction: float = 0.15,
    n_cycles: int = 2,
    steps: int = 5,
    progressive: bool = True,
) -> Column:
    """Requested magnitude of each row, from its index and the series length alone."""
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario must be one of {SCENARIOS}, got {scenario!r}")
    zero, full = F.lit(0.0), F.lit(float(magnitude))
    if scenario == "none" or magnitude == 0.0:
        return zero
    start = position(start_fraction, n)
    end = n if end_fraction is None else position(end_fraction, n)
    inside = (idx >= start) & (idx < end)
    if scenario == "gradual":
        ramp_end = F.least(start + position(duration_fraction, n), end)
        span = ramp_end - start
        level = F.when(idx < ramp_end, full * (idx - start + 1) / span).otherwise(full)
    elif scenario == "recurring":
        period = F.greatest(position(period_fraction, n), F.lit(1))
        lap = F.floor((idx - start) / period)
        level = F.when((F.pmod(lap, F.lit(2)) == 0) & (lap < 2 * n_cycles), full).otherwise(zero)
    elif scenario == "stress" and progressive:
        # The row's plateau is the number of step bounds at or before it.
        bound = lambda j: F.bround(start + (end - start) * F.lit(j / steps))
        passed = sum((F.when(idx >= bound(j), F.lit(1)).otherwise(F.lit(0)) for j in range(1, steps)), F.lit(1))
        level = full * passed / F.lit(float(steps))
    else:
        level = full
    return F.when(inside, level).otherwise(zero)


def drift_channels(
    profile: DataFrame,
    selection: str = "top_variance",
    k: int | None = None,
    explicit: Sequence[str] = (),
    state_flip: bool = False,
    seed: int | Column = 42,
) -> DataFrame:
    """Channels to drift, from the baseline profile: one row per chosen column.

    Discrete channels are chosen only when named explicitly, and are `modified` only under
    the state-flip policy.
    """
    usable = profile.where(F.col("n_unique") > 1)
    if explicit:
        chosen = usable.where(F.col("column").isin(*explicit))
    elif selection == "all_continuous":
        chosen = usable.where(~F.col("is_discrete"))
    elif selection in ("top_variance", "random"):
        if not k or k < 1:
            raise ValueError("k must be at least 1")
        key = F.desc("std") if selection == "top_variance" else uniform(seed, "channels", F.col("column")).asc()
        chosen = usable.where(~F.col("is_discrete")).orderBy(key, "column").limit(k)
    else:
        raise ValueError(f"selection must be one of {SELECTIONS}, got {selection!r}")
    return chosen.select(
        "column", "is_discrete", (~F.col("is_discrete") | F.lit(state_flip)).alias("modified")
    )


def step_size(column: str, level: Column, units: str) -> Column:
    if units == "baseline_sigma":
        return level * stat(column, "std")
    if units == "absolute":
        return level
    if units == "relative":
        return level * F.abs(F.col(column))
    raise ValueError(f"units must be one of {UNITS}, got {units!r}")


def offset(column: str, level: Column, units: str = "baseline_sigma") -> Column:
    return F.col(column) + step_size(column, level, units)


def scale(column: str, level: Column) -> Column:
    return F.col(column) * (F.lit(1.0) + level)


def noise(column: str, level: Column, key: Sequence[Column], seed: int | Column = 42, units: str = "baseline_sigma") -> Column:
    width = step_size(column, level, units)
    return F.when(width > 0, F.col(column) + normal(seed, column, *key) * width).otherwise(F.col(column))


def correlation(pair: tuple[str, str], level: Column) -> tuple[Column, Column]:
    """Rotate a standardised channel pair by level * 45 degrees."""
    theta = level * F.lit(math.pi / 4.0)
    sd = [F.when(stat(c, "std") > 0, stat(c, "std")).otherwise(F.lit(1.0)) for c in pair]
    z = [(F.col(c) - stat(c, "mean")) / s for c, s in zip(pair, sd)]
    first = z[0] * F.cos(theta) - z[1] * F.sin(theta)
    second = z[0] * F.sin(theta) + z[1] * F.cos(theta)
    return first * sd[0] + stat(pair[0], "mean"), second * sd[1] + stat(pair[1], "mean")


def clip_physical(column: str, drifted: Column, active: Column, expansion: float = 1.0) -> Column:
    """Hold a drifted value in the expanded baseline band, never tighter than the original.

    Rows outside the drift keep the recorded value exactly.
    """
    if expansion < 1.0:
        raise ValueError("expansion below 1 would clip inside the baseline range")
    lo_b, hi_b, x = stat(column, "minimum"), stat(column, "maximum"), F.col(column)
    centre, half = (hi_b + lo_b) / 2.0, (hi_b - lo_b) * F.lit(float(expansion)) / 2.0
    held = F.greatest(F.least(drifted, F.greatest(centre + half, x)), F.least(centre - half, x))
    return F.when(active & drifted.isNotNull(), held).otherwise(x)


def state_flip(
    column: str, states: Column, level: Column, top: Column, probability: float, key: Sequence[Column], seed: int = 42
) -> Column:
    """Replace a discrete state by another observed one with probability p * level / top.

    `states` is the sorted array of observed states; the replacement is drawn uniformly from
    the others.
    """
    hit = uniform(seed, f"{column}/flip", *key) < F.lit(float(probability)) * level / top
    others = F.filter(states, lambda s: s != F.col(column))
    pick = F.floor(uniform(seed, f"{column}/state", *key) * F.size(others)).cast("int")
    return F.when(hit & (F.size(others) > 0), F.get(others, pick)).otherwise(F.col(column))


def check_injection(
    role: str, baseline_roles: Sequence[str], mechanism: str, units: str, modify_labels: bool = False,
    start_fraction: float | None = None, baseline_fraction: float | None = None,
) -> None:
    """Refuse an injection that would touch the baseline, the labels or an unknown mechanism."""
    if role in baseline_roles:
        raise ValueError(f"role {role!r} is part of the baseline; drift there would move the reference")
    if mechanism not in MECHANISMS:
        raise ValueError(f"mechanism must be one of {MECHANISMS}, got {mechanism!r}")
    if units not in UNITS:
        raise ValueError(f"units must be one of {UNITS}, got {units!r}")
    if modify_labels:
        raise ValueError("labels are never modified")
    if baseline_fraction is not None and start_fraction is not None and start_fraction < baseline_fraction:
        raise ValueError("drift would start inside the leading baseline fraction")


def inject(
    df: DataFrame,
    columns: Sequence[str],
    level: Column,
    mechanism: str = "offset",
    units: str = "baseline_sigma",
    expansion: float = 1.0,
    key: Sequence[str] = (),
    seed: int | Column = 42,
    suffix: str = "__drifted",
) -> DataFrame:
    """Add `schedule` and one drifted, clipped copy per channel beside the recorded one."""
    if mechanism not in MECHANISMS:
        raise ValueError(f"mechanism must be one of {MECHANISMS}, got {mechanism!r}")
    d = df.withColumn("schedule", level)
    m, active = F.col("schedule"), F.col("schedule") > 0
    if mechanism == "correlation":
        moved: Mapping[str, Column] = {}
        for a, b in zip(columns[0::2], columns[1::2]):
            moved = {**moved, **dict(zip((a, b), correlation((a, b), m)))}
    elif mechanism == "scale":
        moved = {c: scale(c, m) for c in columns}
    elif mechanism == "noise":
        moved = {c: noise(c, m, [F.col(k) for k in key], seed, units) for c in columns}
    else:
        moved = {c: offset(c, m, units) for c in columns}
    kept = {c: F.col(c).cast("double") for c in columns if c not in moved}
    return d.withColumns(
        {
            **{f"{c}{suffix}": clip_physical(c, v, active, expansion) for c, v in moved.items()},
            **{f"{c}{suffix}": v for c, v in kept.items()},
        }
    )


def realised_magnitude(
    df: DataFrame, columns: Sequence[str], mechanism: str = "offset", by: Sequence[str] = (), suffix: str = "__drifted"
) -> DataFrame:
    """Per channel, the shift that survived clipping in baseline sigma, and its attenuation."""
    active = df.where(F.col("schedule") > 0)

    def landed(c: str) -> Column:
        delta = F.col(f"{c}{suffix}") - F.col(c)
        spread = F.stddev_pop(delta) if mechanism == "noise" else F.avg(delta)
        return spread / F.max(stat(c, "std"))

    out = active.groupBy(*by).agg(
        F.avg("schedule").alias("requested"),
        F.count("*").alias("n_drifted_rows"),
        F.array(
            *[F.struct(F.lit(c).alias("column"), landed(c).alias("realised")) for c in columns]
        ).alias("__r"),
    )
    return out.select(*by, "requested", "n_drifted_rows", F.inline("__r")).withColumn(
        "attenuation", F.col("realised") / F.col("requested")
    )


def ground_truth(
    df: DataFrame, scenario: str, mechanism: str, columns: Sequence[str], magnitude: float, seed: int,
    idx: str = "row_idx", by: Sequence[str] = (), suffix: str = "__drifted",
) -> DataFrame:
    """What was injected and what of it arrived, as its own table: never joined into a scoring path.

    `realised_<channel>` is the mean shift over the drifted rows in baseline sigma, after clipping (for noise its spread); `notes`
    names the channels of which more than a twentieth was clipped away.
    """
    hit = F.col("schedule") > 0

    def landed(c: str) -> Column:
        delta = F.when(hit, F.col(f"{c}{suffix}") - F.col(c))
        return (F.stddev_pop(delta) if mechanism == "noise" else F.avg(delta)) / F.max(stat(c, "std"))

    out = df.groupBy(*by).agg(
        F.lit(scenario).alias("scenario"),
        F.lit(mechanism).alias("mechanism"),
        F.min(F.when(hit, F.col(idx))).alias("drift_start_index"),
        (F.max(F.when(hit, F.col(idx))) + 1).alias("drift_end_index"),
        F.lit("|".join(columns)).alias("affected_features"),
        F.lit(float(magnitude)).alias("drift_magnitude"),
        F.lit(seed).alias("random_seed"),
        F.count("*").alias("n_rows"),
        F.count_if(hit).alias("n_drifted_rows"),
        F.avg(F.when(hit, F.col("schedule"))).alias("__asked"),
        *[landed(c).alias(f"realised_{c}") for c in columns],
    )
    less = [F.when(F.abs(F.col(f"realised_{c}")) < 0.95 * F.col("__asked"), F.lit(f"{c} clipped")) for c in columns]
    return out.withColumn("notes", F.array_join(F.array_compact(F.array(*less)), "; ")).drop("__asked")
