"""Row checks. Each returns Columns, so a table is checked without leaving the scan stage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.signals import finite

# Columns that must never enter a feature matrix.
LEAKAGE_COLUMNS = (
    "Target", "Traffic", "StartTime", "LastTime", "RunTime", "SrcAddr",
    "DstAddr", "Sport", "Dport", "Proto", "sIpId", "dIpId",
)
#: The same of the tables that this package is bound to: identifiers, stamps, labels and what is derived from them alone.
BOUND_COLUMNS = ("event_id", "event_type", "user_id", "ts", "y", "series_id", "role", "row_idx")
# Keys refused in a single observation.
FORBIDDEN_KEYS = ("Target", "target", "Traffic", "ground_truth")

# Alert names of a telemetry row.
ALERTS = ("reliability_degraded", "drift_active", "execution_failure_detected", "cloud_fallback_active", "packet_loss")


def leakage_columns(columns: Sequence[str], forbidden: Sequence[str] = (*LEAKAGE_COLUMNS, *BOUND_COLUMNS)) -> list[str]:
    """Those of the columns that no feature set may name, in any letter case."""
    names = {c.lower() for c in forbidden}
    return [c for c in columns if c.lower() in names]


def leakage_guard(columns: Sequence[str], forbidden: Sequence[str] = (*LEAKAGE_COLUMNS, *BOUND_COLUMNS)) -> None:
    """Refuse a feature set that names a label, time, address or identifier column; called at every fit and score."""
    found = leakage_columns(columns, forbidden)
    if found:
        raise ValueError(f"leakage columns in the feature set: {found}")


def validate_observation(features: Sequence[str], expected: int | None = None) -> Column:
    """First problem of the row's feature vector, null when it may be scored."""
    leakage_guard(features, FORBIDDEN_KEYS)
    n = len(features)
    if n == 0:
        return F.lit("empty")
    cols = [F.col(c).cast("double") for c in features]
    problem = F.when(reduce(or_, [c.isNull() for c in cols]), F.lit("missing")).when(
        ~reduce(and_, [finite(c) for c in cols]), F.lit("not_finite")
    )
    if expected is not None and expected != n:
        return F.coalesce(problem, F.lit("dimension"))
    return problem


def validate_prediction(pred: Column, p0: Column, p1: Column) -> Column:
    """First problem of a binary prediction, null when it is well formed."""
    inside = [c.between(-1e-9, 1.0 + 1e-9) for c in (p0, p1)]
    return (
        F.when(pred.isNull() | ~pred.isin(0, 1), F.lit("label"))
        .when(p0.isNull() | p1.isNull(), F.lit("missing_probability"))
        .when(~(finite(p0) & finite(p1)), F.lit("not_finite"))
        .when(~reduce(and_, inside), F.lit("out_of_range"))
        .when(F.abs(p0 + p1 - 1.0) > 1e-4, F.lit("sum"))
    )


def unit_interval_violations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per column, how many values are missing, not finite or outside [0, 1]."""
    bad = lambda c: ~F.coalesce(finite(F.col(c).cast("double")) & F.col(c).between(0, 1), F.lit(False))
    return df.groupBy(*by).agg(*[F.count_if(bad(c)).alias(f"{c}_violations") for c in columns])


def alerts(
    reliability: Column,
    drift_detected: Column,
    persistent: Column,
    severity: Column,
    failed: Column,
    fallback: Column,
    packet_lost: Column,
    reliability_floor: float = 0.5,
    severity_floor: float = 0.1,
) -> Column:
    """Names of the conditions that hold on the row, in a fixed order."""
    drift = (
        F.coalesce(drift_detected, F.lit(False))
        | F.coalesce(persistent, F.lit(False))
        | F.coalesce(severity > severity_floor, F.lit(False))
    )
    conditions = [reliability < reliability_floor, drift, failed, fallback, packet_lost]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in zip(conditions, ALERTS)]))
