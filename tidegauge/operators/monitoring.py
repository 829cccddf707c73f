"""Telemetry tables: running counters, summaries, snapshots and model health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.signals import finite
from tidegauge.operators.metrics import ratio
from tidegauge.operators.ordering import Axis

# Column order of a telemetry row.
TELEMETRY_COLUMNS = (
    "observation_index", "timestamp", "reliability", "confidence", "error_ema", "drift_severity", "quality",
    "selected_action", "previous_action", "decision_reason", "prediction", "model_used", "execution_status",
    "cloud_fallback", "edge_latency_s", "cloud_latency_s", "hybrid_latency_s", "model_version", "drift_detected",
    "is_persistent", "raw_severity", "smoothed_severity", "controller_policy", "network_latency_s", "packet_lost",
)


def running_counters(df: DataFrame, axis: Axis, action: str = "selected_action", success: str = "success") -> DataFrame:
    """Add per-action counts, switches and failures up to each row."""
    stepped = axis.bounded(df, {"__before": lambda w: F.lag(action).over(w)}, back=1)
    count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return axis.running(
        stepped,
        sums={
            **{f"n_{a.lower()}": count(F.col(action) == a) for a in ("EDGE", "CLOUD", "HYBRID")},
            "n_switches": count(F.col(action) != F.col("__before")),
            "n_failed": count(~F.col(success)),
        },
    ).drop("__before")


def telemetry_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of an execution log: actions, outcomes, failures by tier, latency."""
    act, bad = F.col("selected_action"), ~F.col("success")
    in_cloud = F.col("cloud_fallback") | F.lower("model_used").contains("cloud") | F.coalesce(
        F.lower("error").contains("cloud"), F.lit(False)
    )
    hybrid = act == "HYBRID"
    lat = F.col("total_latency_s")
    return log.groupBy(*by).agg(
        F.count("*").alias("total_decisions"),
        F.count_if(F.col("success")).alias("successful_executions"),
        F.count_if(bad).alias("failed_executions"),
        F.count_if(act == "EDGE").alias("edge_count"),
        F.count_if(act == "CLOUD").alias("cloud_count"),
        F.count_if(hybrid).alias("hybrid_count"),
        F.count_if(F.col("cloud_fallback")).alias("hybrid_fallback_count"),
        F.count_if(bad & ((act == "EDGE") | (hybrid & ~in_cloud))).alias("edge_failure_count"),
        F.count_if(bad & ((act == "CLOUD") | (hybrid & in_cloud))).alias("cloud_failure_count"),
        F.sum(lat).alias("total_latency_s"),
        F.avg(lat).alias("mean_latency_s"),
        F.min(lat).alias("min_latency_s"),
        F.max(lat).alias("max_latency_s"),
    )


def _stats(column: str, name: str, idx: str) -> list[Column]:
    """Count, mean, min, max and latest value over finite values only."""
    v = F.when(finite(F.col(column)), F.col(column))
    return [
        F.count(v).alias(f"{name}_count"),
        F.avg(v).alias(f"{name}_mean"),
        F.min(v).alias(f"{name}_min"),
        F.max(v).alias(f"{name}_max"),
        F.max_by(v, F.when(v.isNotNull(), F.col(idx))).alias(f"{name}_current"),
    ]


def monitoring_snapshot(log: DataFrame, axis: Axis, by: Sequence[str] | None = None, reliability_floor: float = 0.5) -> DataFrame:
    """Current state of each series: totals, routing shares, hybrid and execution counts,
    latency, drift and reliability statistics, active alerts."""
    by = list(axis.series if by is None else by)
    stepped = axis.bounded(log, {"__before": lambda w: F.lag("selected_action").over(w)}, back=1)
    act, ok, fell = F.col("selected_action"), F.col("success"), F.col("cloud_fallback")
    latest = lambda c: F.max_by(c, axis.idx).alias(f"current_{c}")
    out = stepped.groupBy(*by).agg(
        F.count("*").alias("total_observations"),
        latest("selected_action"), latest("drift_detected"), latest("is_persistent"), latest("raw_severity"),
        *[F.count_if(act == a).alias(f"n_{a.lower()}") for a in ("EDGE", "CLOUD", "HYBRID")],
        F.count_if(act != F.col("__before")).alias("n_switches"),
        F.count_if((act == "HYBRID") & fell).alias("hybrid_fallbacks"),
        F.count_if((act == "HYBRID") & ok).alias("hybrid_successes"),
        F.count_if(ok).alias("n_successful"),
        F.count_if(~ok).alias("n_failed"),
        F.count_if((act == "EDGE") & ~ok).alias("edge_failures"),
        F.count_if((act == "CLOUD") & ~ok).alias("cloud_failures"),
        *_stats("edge_latency_s", "edge_latency", axis.idx),
        *_stats("cloud_latency_s", "cloud_latency", axis.idx),
        *_stats("smoothed_severity", "severity", axis.idx),
        *_stats("reliability", "reliability", axis.idx),
    )
    total = F.col("total_observations")
    drift = F.coalesce(F.col("current_drift_detected") | F.col("current_is_persistent"), F.lit(False))
    # Alert names of a snapshot.
    active = F.array_compact(
        F.array(
            F.when(F.col("reliability_current") < reliability_floor, F.lit("reliability_degraded")),
            F.when(drift, F.lit("drift_active")),
            F.when(F.col("n_failed") > 0, F.lit("execution_failures_recorded")),
        )
    )
    return out.withColumns(
        {
            **{f"{a}_share": ratio(F.col(f"n_{a}") * 100.0, total) for a in ("edge", "cloud", "hybrid")},
            "hybrid_fallback_rate": ratio(F.col("hybrid_fallbacks").cast("double"), F.col("n_hybrid")),
            "success_rate": ratio(F.col("n_successful").cast("double"), total, 1.0),
            "active_alerts": F.array_join(active, "|"),
        }
    )


def model_health(log: DataFrame, idx: str = "observation_index", by: Sequence[str] = ()) -> DataFrame:
    """Per model: executions, outcomes, and the latest latency, status and error.

    A hybrid row runs the edge model, and the cloud model too when it fell back.
    """
    act, fell, ok = F.col("selected_action"), F.col("cloud_fallback"), F.col("success")
    call = lambda when, model, good, lat, status: F.when(
        when,
        F.struct(
            F.lit(model).alias("model_id"), good.alias("ok"), F.col(lat).alias("latency_s"), status.alias("status"),
            F.when(~good, F.coalesce("error", F.lit("Execution failure"))).alias("problem"),
        ),
    )
    status = F.col("execution_status")
    hybrid = act == "HYBRID"
    calls = F.array_compact(
        F.array(
            call(act == "EDGE", "edge", ok, "edge_latency_s", status),
            call(hybrid, "edge", F.lit(True), "edge_latency_s", F.lit("SUCCESS")),
            call((act == "CLOUD") | (hybrid & fell), "cloud", ok, "cloud_latency_s", status),
        )
    )
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(idx)))
    return (
        log.select(*by, idx, F.inline(calls))
        .groupBy(*by, "model_id")
        .agg(
            F.count("*").alias("total_executions"),
            F.count_if(F.col("ok")).alias("successful_executions"),
            F.count_if(~F.col("ok")).alias("failed_executions"),
            newest("latency_s").alias("last_latency_s"),
            newest("status").alias("last_execution_status"),
            newest("problem").alias("last_error"),
        )
    )
