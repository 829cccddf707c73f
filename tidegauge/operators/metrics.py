"""Evaluation tables: every function is one or two grouped aggregations over a run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.student import t_quantile, t_two_sided_p
from tidegauge.operators.ordering import Axis
from tidegauge.operators.profile import exact_quantiles

SCORES = ("accuracy", "precision", "recall", "f1", "mcc")


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def confusion(label: Column, pred: Column, among: Column | None = None) -> dict[str, Column]:
    """The four counts of a binary confusion matrix, optionally among some rows only."""
    keep = F.lit(True) if among is None else among
    hit = lambda y, p: F.count_if(keep & (label == y) & (pred == p))
    return {"tp": hit(1, 1), "fp": hit(0, 1), "fn": hit(1, 0), "tn": hit(0, 0)}


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, macro precision / recall / F1 over the classes present, and MCC; 0 if undefined."""
    d = lambda c: c.cast("double")
    has1, has0 = d((tp + fp + fn) > 0), d((tn + fp + fn) > 0)
    macro = lambda one, zero: ratio(has1 * one + has0 * zero, has1 + has0)
    f1 = lambda t: ratio(2.0 * t, 2.0 * t + fp + fn)
    margins = d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn)
    return {
        "accuracy": ratio(d(tp + tn), d(tp + fp + fn + tn)),
        "precision": macro(ratio(d(tp), d(tp + fp)), ratio(d(tn), d(tn + fn))),
        "recall": macro(ratio(d(tp), d(tp + fn)), ratio(d(tn), d(tn + fp))),
        "f1": macro(f1(d(tp)), f1(d(tn))),
        "mcc": ratio(d(tp) * d(tn) - d(fp) * d(fn), F.sqrt(margins)),
    }


def classification_metrics(
    df: DataFrame, label: str = "label", pred: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Scores, the 2x2 matrix and the row count per group; rows without a prediction are left out.

    Without groups, an empty input gives one row of zeros.
    """
    return scored_counts(df.groupBy(*by).agg(*[c.alias(n) for n, c in confusion(F.col(label), F.col(pred)).items()]), by)


def scored_counts(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from the counts tp, fp, fn and tn of every group."""
    matrix = [F.col(n) for n in ("tp", "fp", "fn", "tn")]
    return counted.select(
        *by,
        *[c.alias(n) for n, c in scores(*matrix).items()],
        (matrix[0] + matrix[1] + matrix[2] + matrix[3]).alias("sample_count"),
        *matrix,
    )


def pre_post_metrics(
    df: DataFrame, label: str, pred: str, idx: str, onset: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Scores before and from the onset, their difference and its percentage."""
    early = F.col(idx) < onset
    aggs = []
    for tag, among in (("pre", early), ("post", ~early)):
        aggs += [c.alias(f"__{tag}_{n}") for n, c in confusion(F.col(label), F.col(pred), among).items()]
        aggs.append(F.count_if(among).alias(f"{tag}_samples"))
    counted = df.groupBy(*by).agg(*aggs)
    cells = lambda tag: [F.col(f"__{tag}_{n}") for n in ("tp", "fp", "fn", "tn")]
    pre, post = scores(*cells("pre")), scores(*cells("post"))
    cols = [F.col("pre_samples"), F.col("post_samples")]
    for n in SCORES:
        delta = post[n] - pre[n]
        change = F.when(F.abs(pre[n]) > 1e-9, delta / pre[n] * 100.0).otherwise(F.lit(0.0))
        cols += [
            pre[n].alias(f"pre_{n}"), post[n].alias(f"post_{n}"),
            delta.alias(f"delta_{n}"), change.alias(f"pct_change_{n}"),
        ]
    return counted.select(*by, *cols)


def drift_metrics(
    df: DataFrame, idx: str, alarm: str, persistent: str, severity: str, onset: Column | None, by: Sequence[str] = ()
) -> DataFrame:
    """Detection delay and alarm counts against the known onset, or the no-drift form of them."""
    at, hit = F.col(idx), F.col(alarm)
    common = [
        F.count_if(hit).alias("total_alarms"),
        F.count_if(hit & ~F.col(persistent)).alias("transient_alarms"),
        F.count_if(F.col(persistent)).alias("persistent_events"),
        F.avg(severity).alias("mean_severity"),
        F.max(severity).alias("max_severity"),
    ]
    if onset is None:
        out = df.groupBy(*by).agg(F.min(F.when(hit, at)).alias("first_detection_point"), *common)
        return out.select(
            *by, "first_detection_point", F.lit("NO_DRIFT").alias("detection_status"), "total_alarms",
            F.col("total_alarms").alias("false_alarms_pre_drift"), "transient_alarms", "persistent_events",
            "mean_severity", "max_severity",
        )
    late = at >= F.col("__onset")
    out = df.withColumn("__onset", onset.cast("long")).groupBy(*by).agg(
        F.max("__onset").alias("drift_onset"),
        F.min(F.when(hit & late, at)).alias("first_detection_point"),
        F.count_if(hit & ~late).alias("false_alarms_pre_drift"),
        F.count_if(hit & late).alias("post_drift_alarms"),
        F.avg(F.when(late, F.col(severity))).alias("post_drift_mean_severity"),
        *common,
    )
    found = F.col("first_detection_point")
    return out.select(
        *by, "drift_onset", "first_detection_point", (found - F.col("drift_onset")).alias("detection_delay"),
        F.when(found.isNotNull(), F.lit("DETECTED")).otherwise(F.lit("NOT DETECTED")).alias("detection_status"),
        "total_alarms", "false_alarms_pre_drift", "post_drift_alarms", "transient_alarms", "persistent_events",
        "mean_severity", "max_severity", F.coalesce("post_drift_mean_severity", F.lit(0.0)).alias("post_drift_mean_severity"),
    )


def reliability_metrics(df: DataFrame, idx: str, reliability: str, onset: Column, by: Sequence[str] = ()) -> DataFrame:
    r, early = F.col(reliability), F.col(idx) < onset
    out = df.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(early, r)), F.lit(0.0)).alias("mean_reliability_pre_drift"),
        F.coalesce(F.avg(F.when(~early, r)), F.lit(0.0)).alias("mean_reliability_post_drift"),
        F.min(r).alias("min_reliability"),
        F.max(r).alias("max_reliability"),
    )
    return out.withColumn(
        "delta_reliability", F.col("mean_reliability_post_drift") - F.col("mean_reliability_pre_drift")
    )


def routing_metrics(
    df: DataFrame, axis: Axis, action: str = "action", fallback: str | None = None, by: Sequence[str] | None = None
) -> DataFrame:
    """Counts and shares per action, switches between neighbouring rows, hybrid fallbacks.

    Switches are counted within a series; `by` may group several series.
    """
    by = list(axis.series if by is None else by)
    stepped = axis.bounded(df, {"__before": lambda w: F.lag(action).over(w)}, back=1)
    count = lambda a: F.count_if(F.col(action) == a)
    fell = F.count_if(F.col(fallback)) if fallback else F.lit(0).cast("long")
    out = stepped.groupBy(*by).agg(
        F.count("*").alias("total_decisions"),
        count("EDGE").alias("edge_count"),
        count("CLOUD").alias("cloud_count"),
        count("HYBRID").alias("hybrid_count"),
        F.count_if(F.col(action) != F.col("__before")).alias("switch_count"),
        fell.alias("hybrid_fallback_count"),
    )
    share = lambda c: ratio(F.col(c) * 100.0, F.col("total_decisions"))
    return out.select(
        *by, "total_decisions", "edge_count", "cloud_count", "hybrid_count",
        share("edge_count").alias("edge_percentage"),
        share("cloud_count").alias("cloud_percentage"),
        share("hybrid_count").alias("hybrid_percentage"),
        share("cloud_count").alias("offloading_ratio"),
        "switch_count", "hybrid_fallback_count",
        F.greatest(F.col("hybrid_count") - F.col("hybrid_fallback_count"), F.lit(0)).alias("edge_completed_hybrid_count"),
        ratio(F.col("hybrid_fallback_count") * 100.0, F.col("hybrid_count")).alias("hybrid_fallback_rate"),
        F.when(F.col("hybrid_count") > 0, F.lit("OBSERVED")).otherwise(F.lit("NOT OBSERVED")).alias("hybrid_status"),
    )


def hybrid_metrics(routing: DataFrame, by: Sequence[str]) -> DataFrame:
    return routing.select(
        *by, "hybrid_count", F.col("edge_completed_hybrid_count").alias("edge_completed_hybrid"),
        F.col("hybrid_fallback_count").alias("cloud_fallback_count"), "hybrid_fallback_rate", "hybrid_status",
    )


def latency_summary(df: DataFrame, seconds: str, by: Sequence[str] = (), empty_as_null: bool = False) -> DataFrame:
    """Count, mean, median, P95 (interpolated) and maximum in seconds and milliseconds.

    Missing values are left out; a group without any shows zeros, or nulls on request.
    """
    clean = df.withColumn("__l", F.when(~F.isnan(seconds), F.col(seconds)))
    basic = clean.groupBy(*by).agg(
        F.count("__l").alias("count"), F.avg("__l").alias("mean_s"), F.max("__l").alias("max_s")
    )
    marks = exact_quantiles(clean, ["__l"], [0.5, 0.95], by).select(
        *by, F.col("q0").alias("median_s"), F.col("q1").alias("p95_s")
    )
    out = basic.join(marks, list(by), "left") if by else basic.join(marks, F.lit(True), "left")
    stats = ("mean", "median", "p95", "max")
    value = lambda n: F.col(f"{n}_s") if empty_as_null else F.coalesce(F.col(f"{n}_s"), F.lit(0.0))
    return out.select(
        *by, "count", *[(value(n) * 1000.0).alias(f"{n}_ms") for n in stats], *[value(n).alias(f"{n}_s") for n in stats]
    )


def execution_reliability(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Success and failure shares of an execution log and failures by tier and cause."""
    bad = ~F.col("success")
    out = log.groupBy(*by).agg(
        F.count("*").alias("total_executions"),
        F.count_if(F.col("success")).alias("successful_executions"),
        F.count_if(bad & (F.col("model_used") == "edge")).alias("edge_failures"),
        F.count_if(bad & F.col("model_used").contains("cloud")).alias("cloud_failures"),
        F.count_if(F.col("packet_lost")).alias("packet_loss_failures"),
        F.count_if(bad & F.col("cloud_fallback")).alias("fallback_failures"),
    )
    n, ok = F.col("total_executions"), F.col("successful_executions")
    return out.withColumns(
        {
            "failed_executions": n - ok,
            "success_rate": ratio(ok.cast("double"), n),
            "failure_rate": ratio((n - ok).cast("double"), n),
        }
    )


def delivery_metrics(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Transmissions delivered, failed and lost, with the latency of the delivered ones.

    Rows without a network latency made no transmission. Rates are null without any.
    """
    sent = log.where(F.col("network_latency_s").isNotNull())
    out = sent.groupBy(*by).agg(
        F.count("*").alias("total_transmissions"),
        F.count_if(F.col("success")).alias("delivered_transmissions"),
        F.count_if(~F.col("success")).alias("failed_transmissions"),
        F.count_if(F.col("packet_lost")).alias("packet_loss_count"),
    )
    share = lambda c: ratio(F.col(c).cast("double"), F.col("total_transmissions"), None)
    rates = out.withColumns(
        {
            "delivery_rate": share("delivered_transmissions"),
            "failure_rate": share("failed_transmissions"),
            "packet_loss_rate": share("packet_loss_count"),
        }
    )
    times = latency_summary(sent.where("success"), "network_latency_s", by, empty_as_null=True)
    keep = times.select(*by, *[c for c in times.columns if c.endswith("_ms")])
    return rates.join(keep, list(by), "left") if by else rates.join(keep, F.lit(True), "left")


# The compared configurations, and whether each uses the drift signal / retraining.
CONFIGURATIONS = {
    "EDGE_ONLY": (False, False),
    "CLOUD_ONLY": (False, False),
    "STATIC": (False, False),
    "NO_DRIFT_SIGNAL": (False, False),
    "ADAPTIVE": (True, False),
    "ADAPTIVE_RETRAINED": (True, True),
}


def mean_by_configuration(prediction: DataFrame, routing: DataFrame, latency: DataFrame, by: str = "method") -> DataFrame:
    """Mean post-drift F1, offloading and latency per configuration; null where not measured."""
    f1 = prediction.groupBy(by).agg(F.avg("post_f1").alias("post_drift_macro_f1"))
    off = routing.groupBy(by).agg(F.avg("offloading_ratio").alias("cloud_offloading_percentage"))
    lat = latency.groupBy(by).agg(F.avg("mean_ms").alias("mean_latency_ms"))
    uses = lambda k: [name for name, used in CONFIGURATIONS.items() if used[k]]
    flag = lambda k: F.when(F.col(by).isin(*uses(k)), F.lit("YES")).otherwise(F.lit("NO"))
    return off.join(f1, by, "left").join(lat, by, "left").withColumns(
        {"drift_signal_used": flag(0), "adaptation_used": flag(1)}
    )


def _interval(n: Column, mean: Column, std: Column, confidence: float) -> tuple[Column, Column, Column]:
    flat = (n < 2) | (std < 1e-12) | std.isNull()
    margin = t_quantile(F.lit((1.0 + confidence) / 2.0), (n - 1).cast("double")) * F.try_divide(std, F.sqrt(n))
    shown = F.when(flat, F.lit(0.0)).otherwise(std)
    return shown, F.when(flat, mean).otherwise(mean - margin), F.when(flat, mean).otherwise(mean + margin)


def confidence_interval(df: DataFrame, value: str, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Mean, sample std and Student-t interval per group; degenerate groups collapse to the mean."""
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.stddev_samp(value).alias("__std"),
    )
    std, lo, hi = _interval(F.col("n"), F.col("mean"), F.col("__std"), confidence)
    return out.select(*by, "n", "mean", std.alias("std"), lo.alias("ci_lower"), hi.alias("ci_upper"))


def paired_by_seed(df: DataFrame, first: str, second: str, metric: str, method: str = "method", seed: str = "seed") -> DataFrame:
    """Two methods' values side by side per seed."""
    side = lambda m, name: df.where(F.col(method) == m).select(seed, F.col(metric).alias(name))
    return side(first, "first_value").join(side(second, "second_value"), seed).withColumn(
        "difference", F.col("first_value") - F.col("second_value")
    )


def paired_test(pairs: DataFrame, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Paired t statistic with p-value and interval of the mean difference.

    Fewer than two pairs, or differences without variance, are labelled instead of tested.
    """
    diff = F.col("difference")
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("n_replicates"),
        F.avg("first_value").alias("m1_mean"),
        F.avg("second_value").alias("m2_mean"),
        F.avg(diff).alias("mean_difference"),
        F.stddev_samp(diff).alias("__std"),
        (F.max(diff) - F.min(diff)).alias("__range"),
    )
    n, mean = F.col("n_replicates"), F.col("mean_difference")
    tested = (n >= 2) & (F.col("__range") > 1e-12 + 1e-5 * F.abs(mean))
    t = F.try_divide(mean, F.col("__std") / F.sqrt(n))
    _, lo, hi = _interval(n, mean, F.col("__std"), confidence)
    # Test names.
    name = (
        F.when(n < 2, F.lit("NOT STATISTICALLY TESTABLE"))
        .when(~tested, F.lit("Exact zero-variance paired difference"))
        .otherwise(F.lit("Paired t-test"))
    )
    p = t_two_sided_p(F.coalesce(t, F.lit(0.0)), (n - 1).cast("double"))
    return out.select(
        *by, "n_replicates", name.alias("test_name"),
        F.when(n < 2, F.lit(None)).when(tested, t).otherwise(F.lit(0.0)).alias("statistic"),
        F.when(n < 2, F.lit(None)).when(tested, p).otherwise(F.lit(1.0)).alias("p_value"),
        "m1_mean", "m2_mean", "mean_difference", lo.alias("diff_ci_95_lower"), hi.alias("diff_ci_95_upper"),
    )


def run_consistency(runs: DataFrame, scores_in_unit: Sequence[str], finite_columns: Sequence[str]) -> DataFrame:
    """Checks over raw run rows: bounds, finiteness, unique seeds, shares summing to 100."""
    unit = [F.count_if(~F.coalesce(F.col(c).between(0, 1), F.lit(False))) for c in scores_in_unit]
    number = [
        F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c in finite_columns
    ]
    total = F.col("edge_percentage") + F.col("cloud_percentage") + F.col("hybrid_percentage")
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.count_distinct("method", "seed").alias("n_method_seed"),
        sum(unit[1:], unit[0]).alias("n_out_of_bounds"),
        sum(number[1:], number[0]).alias("n_not_finite"),
        F.count_if(F.abs(total - 100.0) > 1e-6).alias("n_bad_share_sum"),
    )
