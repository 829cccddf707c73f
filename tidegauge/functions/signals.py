"""Row formulas: confidence, losses, quality, severity, reliability. All are Column -> Column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the signals a detector may watch.
MONITORED_SIGNALS = ("prediction_probability", "uncertainty", "predicted_class", "prediction_error")

# Default weights of the reliability mean.
RELIABILITY_WEIGHTS = {"confidence": 0.25, "error": 0.25, "drift": 0.25, "quality": 0.25}


def clip(c: Column, lo: float, hi: float) -> Column:
    """Hold a value in [lo, hi]; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def finite(c: Column) -> Column:
    """True for a present number that is neither NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(c: Column) -> Column:
    """pandas skips NaN in every aggregate; Spark does so only for null."""
    return F.when(~F.isnan(c), c)


def probability_normalise(p0: Column, p1: Column) -> tuple[Column, Column]:
    """Scale to sum one; certain of class 0 when both are zero."""
    total = p0 + p1
    return (
        F.when(total > 0, p0 / total).otherwise(F.lit(1.0)),
        F.when(total > 0, p1 / total).otherwise(F.lit(0.0)),
    )


def confidence(p0: Column, p1: Column) -> Column:
    """2 * (max(p0, p1) - 0.5), with the maximum held in [0.5, 1]; a missing p counts as 0.5."""
    top = F.greatest(F.coalesce(p0, F.lit(0.5)), F.coalesce(p1, F.lit(0.5)))
    return F.lit(2.0) * (clip(top, 0.5, 1.0) - F.lit(0.5))


def zero_one_loss(pred: Column, label: Column) -> Column:
    return (pred != label).cast("double")


def quality_score(flags: Sequence[Column], n_features: int | None = None) -> Column:
    """Share of valid channels, held in [0, 1]; a missing flag counts as valid."""
    n = len(flags) if n_features is None else n_features
    if n <= 0:
        return F.lit(1.0)
    total = reduce(add, [F.coalesce(f.cast("double"), F.lit(1.0)) for f in flags])
    return clip(total / F.lit(float(n)), 0.0, 1.0)


def quality_scalar(q: Column) -> Column:
    return F.when(q.isNull(), F.lit(1.0)).otherwise(clip(q.cast("double"), 0.0, 1.0))


def harmonic_reliability(
    conf: Column,
    error: Column,
    drift: Column,
    quality: Column,
    weights: Mapping[str, float] | None = None,
    epsilon: float = 1e-8,
) -> Column:
    """Weighted harmonic mean of confidence, 1-error, 1-drift and quality."""
    w = {**RELIABILITY_WEIGHTS, **(weights or {})}
    total = sum(w.values())
    if total <= 0:
        raise ValueError("reliability weights must have a positive sum")
    parts = {"confidence": conf, "error": F.lit(1.0) - error, "drift": F.lit(1.0) - drift, "quality": quality}
    eps = F.lit(max(float(epsilon), 1e-12))
    denominator = reduce(
        add, [F.lit(w[k] / total) / (clip(c, 0.0, 1.0) + eps) for k, c in parts.items()]
    )
    return clip(F.lit(1.0) / denominator, 0.0, 1.0)


def reliability_defaults(conf: Column, drift: Column) -> tuple[Column, Column]:
    """Neutral confidence 0.5 and zero drift where nothing was measured."""
    return (
        F.coalesce(clip(conf, 0.0, 1.0), F.lit(0.5)),
        F.coalesce(clip(drift, 0.0, 1.0), F.lit(0.0)),
    )


def raw_severity(
    value: Column,
    baseline_mean: Column,
    formula: str = "relative_shift",
    max_shift: float | None = None,
    sensitivity: float = 1.0,
) -> Column:
    """Distance from the baseline mean mapped into [0, 1]."""
    shift = F.abs(value - baseline_mean)
    if formula == "relative_shift":
        if max_shift is not None:
            span = F.lit(max_shift if max_shift > 0 else 1e-6)
        else:
            span = F.greatest(F.lit(1.0) - baseline_mean, F.lit(1e-6))
        return clip(shift / span, 0.0, 1.0)
    if formula == "exponential":
        return clip(F.lit(1.0) - F.exp(F.lit(-float(sensitivity)) * shift), 0.0, 1.0)
    raise ValueError(f"unknown severity formula {formula!r}")


def monitored_signal(kind: str, p0: Column, p1: Column, pred: Column | None = None, error: Column | None = None) -> Column:
    """The scalar a drift detector watches."""
    if kind == "prediction_probability":
        return F.coalesce(p1, F.lit(0.0))
    if kind == "uncertainty":
        top = F.greatest(F.coalesce(p0, F.lit(0.5)), F.coalesce(p1, F.lit(0.5)))
        return F.lit(2.0) * (F.lit(1.0) - top)
    if kind == "predicted_class":
        derived = (F.coalesce(p1, F.lit(0.0)) >= F.coalesce(p0, F.lit(0.0))).cast("double")
        return derived if pred is None else F.coalesce(pred.cast("double"), derived)
    if kind == "prediction_error":
        if error is None:
            raise ValueError("prediction_error needs an error column; labels are not looked up here")
        return error.cast("double")
    raise ValueError(f"unknown signal {kind!r}; expected one of {MONITORED_SIGNALS}")


def winsorized_l1(z: Sequence[Column], limit: float = 5.0) -> Column:
    """Mean over the features of min(|z|, limit)."""
    return reduce(add, [clip(F.abs(c), 0.0, limit) for c in z]) / F.lit(float(len(z)))


def ts_resolution(n_with_seconds: Column, n_with_minutes: Column, n_with_hours: Column) -> Column:
    """Coarsest unit that explains the stamps, from counts of stamps with a non-zero part."""
    return (
        F.when(n_with_seconds > 0, F.lit("second"))
        .when(n_with_minutes > 0, F.lit("minute"))
        .when(n_with_hours > 0, F.lit("hour"))
        .otherwise(F.lit("day"))
    )
