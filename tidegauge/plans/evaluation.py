"""Named queries over the driver's tables: scores, detection, routing, feedback, evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import checks, signals
from tidegauge.functions.draws import uniform
from tidegauge.operators import detect, feedback, metrics, models, monitoring, routing, trees
from tidegauge.operators.ordering import WAVE_ROWS, Axis, series_waves
from tidegauge.plans import adapt
from tidegauge.plans import events as E
from tidegauge.plans import runs as R
from tidegauge.plans.catalog import query, tidy
from tidegauge.session import materialise, passing, shared_dir
from tidegauge.sources import sinks, tables
from tidegauge.streaming import ordered, stateful

ID = ("series_id", "row_idx")
METHOD_SEED = ["method", "seed"]


# ---- scalar functions ------------------------------------------------------------------------


@query
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.scored(spark, sf_dir)
    return tidy(d.select(*ID, signals.confidence(F.col("p0"), F.col("p1")).alias("confidence")))


@query
def zero_one_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.scored(spark, sf_dir)
    return tidy(d.select(*ID, signals.zero_one_loss(F.col("edge_pred"), F.col("y")).alias("loss")))


@query
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.telemetry(spark, sf_dir)
    flags = [F.col("amount").isNotNull(), F.col("value") < 100, F.when(F.col("state") > 0, F.col("k") > 10)]
    return tidy(d.select("event_id", signals.quality_score(flags).alias("quality"), signals.quality_scalar(F.col("amount") / 50.0).alias("scalar")))


@query
def harmonic_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.telemetry(spark, sf_dir)
    r = signals.harmonic_reliability(
        F.col("k") / 100.0, F.least(F.col("value") / 300.0, F.lit(1.0)), F.col("state") / 4.0, F.lit(0.9),
        {"confidence": 0.4, "drift": 0.3},
    )
    return tidy(d.select("event_id", r.alias("reliability")))


@query
def reliability_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.telemetry(spark, sf_dir)
    conf, drift = signals.reliability_defaults(F.col("amount") / 100.0, F.when(F.col("state") == 1, F.col("k") / 50.0))
    return tidy(d.select("event_id", conf.alias("confidence"), drift.alias("drift")))


@query
def raw_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.scored(spark, sf_dir)
    s, mean = F.col("signal"), F.lit(0.6)
    return tidy(
        d.select(
            *ID,
            signals.raw_severity(s, mean).alias("relative"),
            signals.raw_severity(s, mean, max_shift=1.0).alias("relative_unit"),
            signals.raw_severity(s, mean, "exponential", sensitivity=2.0).alias("exponential"),
        )
    )


@query
def monitored_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.scored(spark, sf_dir)
    p0, p1 = F.col("p0"), F.col("p1")
    error = signals.zero_one_loss(F.col("edge_pred"), F.col("y"))
    return tidy(d.select(*ID, *[signals.monitored_signal(k, p0, p1, error=error).alias(k) for k in signals.MONITORED_SIGNALS]))


@query
def winsorized_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.normalised(spark, sf_dir)
    z = [F.col("z_value"), F.col("z_k")]
    return tidy(d.select("event_id", signals.winsorized_l1(z).alias("wide"), signals.winsorized_l1(z, 1.0).alias("tight")))


@query
def probability_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.telemetry(spark, sf_dir)
    p0, p1 = signals.probability_normalise(F.col("k") * F.col("state"), F.col("state") * 10.0)
    return tidy(d.select("event_id", p0.alias("p0"), p1.alias("p1")))


# ---- severity, error, reliability, persistence --------------------------------------------------


@query
def severity_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.with_severity(spark, sf_dir).select(*ID, "raw_severity", "smoothed_severity"))


@query
def error_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.reliable(spark, sf_dir).select(*ID, "error_ema"))


@query
def error_ema_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels arrive for some rows only: purchases report at once, other types never."""
    d = E.ordered(spark, sf_dir).where(F.col("role") == "inference").select("series_id", "row_idx", "event_type", "k")
    loss = F.when(F.col("event_type") == "purchase", F.col("k") / 99.0)
    return tidy(routing.error_ema(d, E.STREAM, loss, 0.9, 0.25).select(*ID, "error_ema"))


def alarmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with an alarm wherever raw severity is high."""
    d = E.reliable(spark, sf_dir)
    return d.select(*ID, "raw_severity", "smoothed_severity", "reliability", "ts", (F.col("raw_severity") > 0.55).alias("alarm"))


@query
def persistence_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.persistence_consecutive(alarmed(spark, sf_dir), E.STREAM, "alarm", 3).select(*ID, "alarm", "is_persistent")


@query
def persistence_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect.persistence_windowed(alarmed(spark, sf_dir), E.STREAM, "alarm", 20, 8)
    d = detect.alarm_rate(d, E.STREAM, "alarm")
    return tidy(d.select(*ID, "alarms_in_window", "is_persistent", "total_alarms", "alarm_rate"))


@query
def severity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(detect.severity_history(alarmed(spark, sf_dir), E.STREAM, "alarm"))


@query
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = E.execution_log(spark, sf_dir).join(alarmed(spark, sf_dir), list(ID))
    names = checks.alerts(
        F.col("reliability"), F.col("alarm"), F.lit(False), F.col("smoothed_severity"),
        ~F.col("success"), F.col("cloud_fallback"), F.col("packet_lost"), severity_floor=0.35,
    )
    return log.select(*ID, F.array_join(names, "|").alias("alerts"))


# ---- detection ---------------------------------------------------------------------------------


def by_devices(d: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` on ranges of devices, one after another, so that what it writes in between is of one range; d: rows of every seed."""
    return reduce(DataFrame.unionByName, [work(d.where(devices)) for devices in series_waves(d, "series_id", len(R.SEEDS) * WAVE_ROWS)])


@query
def adwin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive window over the drifted signal of every seed and device."""
    d = R.replayed(spark, sf_dir).where(F.col("method") == "ADAPTIVE")
    last = E.last_index(spark, sf_dir)

    def detect_in(some: DataFrame) -> DataFrame:
        with passing(spark, "readings"):
            out = detect.adwin(some, R.SEEDED, "signal", clock=8, last_index=last)
            return materialise(out.select("seed", *ID, "value", "drift_detected", "estimation", "width", "n_alarms"), "readings")

    return tidy(by_devices(d, detect_in))


@query
def adwin_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same detector on bins of four rows."""
    d = R.replayed(spark, sf_dir).where(F.col("method") == "ADAPTIVE")
    out = detect.adwin(d, R.SEEDED, "signal", clock=8, bin_rows=4)
    return tidy(out.select("seed", *ID, "value", "drift_detected", "estimation", "width"))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the adaptive method with alarms, persistence and severity (written once)."""

    def detect_in(d: DataFrame) -> DataFrame:
        with passing(spark, "detected"):
            a = detect.adwin(d, R.SEEDED, "signal", clock=8).select("seed", *ID, "drift_detected", "estimation", "width")
            p = detect.persistence_windowed(materialise(a, "alarms"), R.SEEDED, "drift_detected", 100, 1)
            return materialise(d.join(p.hint("merge"), ["seed", *ID]), "detected")

    def build() -> DataFrame:
        return by_devices(R.replayed(spark, sf_dir).where(F.col("method") == "ADAPTIVE"), detect_in)

    return E.staged(spark, sf_dir, "detected", build)


@query
def drift_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector, persistence and severity per row."""
    d = detected(spark, sf_dir)
    return tidy(d.select("seed", *ID, "drift_detected", "is_persistent", "raw_severity", "smoothed_severity", "estimation"))


# ---- routing -----------------------------------------------------------------------------------


def routed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return routing.route_hysteresis(E.reliable(spark, sf_dir), E.STREAM, **options)


@query
def route_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = routed(spark, sf_dir, critical=0.2, cloud_below=0.4, edge_from=0.5)
    return d.select(*ID, "action", "previous_action", "reason", "switch_count")


@query
def route_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controller without its middle state, starting in it."""
    d = routed(spark, sf_dir, critical=0.2, cloud_below=0.4, edge_from=0.5, hybrid=False, initial="HYBRID")
    return d.select(*ID, "action", "switch_count")


@query
def route_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.ordered(spark, sf_dir).where(F.col("role") == "inference")
    return d.select(*ID, *[routing.route_static(F.col("row_idx"), p, 0.25).alias(p) for p in routing.POLICIES])


@query
def two_tier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = routed(spark, sf_dir, critical=0.2, cloud_below=0.4, edge_from=0.5).select(*ID, "z_value", "z_k", "action")
    out = routing.two_tier_score(
        d, models.logistic_scorer(E.EDGE_WEIGHTS), models.logistic_scorer(E.CLOUD_WEIGHTS), list(ID)
    )
    return tidy(out.select(*ID, "p1", "prediction", "model_used", "cloud_fallback", "execution_status"))


@query
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, drifted rows and mean signal of every method and seed."""
    d = R.replayed(spark, sf_dir)
    return tidy(
        d.groupBy(*METHOD_SEED).agg(
            F.count("*").alias("n_rows"), F.count_if("is_post").alias("n_post"), F.avg("signal").alias("mean_signal"),
            F.avg("smoothed_severity").alias("mean_severity"),
        )
    )


def sweep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["magnitude", "breadth"]
    d = R.swept(spark, sf_dir)
    r = metrics.reliability_metrics(d, "row_idx", "reliability", F.col("onset"), by)
    shares = metrics.routing_metrics(d, R.SWEPT, "action", "cloud_fallback", by)
    return r.join(shares, by).select(
        *by, "min_reliability", "mean_reliability_post_drift", "edge_percentage", "hybrid_percentage", "cloud_percentage",
        "switch_count", "hybrid_fallback_count",
    )


@query
def drift_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability and routing of the adaptive method by drift strength and breadth."""
    return tidy(sweep_table(spark, sf_dir))


@query
def closed_loop_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row error, reliability, action and answer of every run, answers feeding back."""
    d = R.replayed(spark, sf_dir)
    return tidy(d.select(*METHOD_SEED, *ID, "error_ema", "reliability", "action", "prediction", "cloud_fallback"))


@query
def row_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain per row: signal, alarm, persistence, severity, error, reliability, action."""
    d = detected(spark, sf_dir)
    return tidy(
        d.select(
            "seed", *ID, "signal", "drift_detected", "is_persistent", "raw_severity", "smoothed_severity",
            "confidence", "error_ema", "reliability", "action", "prediction", "cloud_fallback",
        )
    )


# ---- evaluation tables ----------------------------------------------------------------------------


@query
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.classification_metrics(R.replayed(spark, sf_dir), by=METHOD_SEED))


@query
def pre_post_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pre_post(spark, sf_dir))


def pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pre_post_metrics(R.replayed(spark, sf_dir), "label", "prediction", "row_idx", F.col("onset"), METHOD_SEED)


@query
def drift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = alarmed(spark, sf_dir)
    d = detect.persistence_windowed(d, E.STREAM, "alarm", 20, 8)
    return tidy(metrics.drift_metrics(d, "row_idx", "alarm", "is_persistent", "smoothed_severity", F.lit(100), ["series_id"]))


@query
def drift_metrics_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect.persistence_consecutive(alarmed(spark, sf_dir), E.STREAM, "alarm", 3)
    return tidy(metrics.drift_metrics(d, "row_idx", "alarm", "is_persistent", "smoothed_severity", None, ["series_id"]))


@query
def drift_metrics_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table over the detector's own alarms."""
    return tidy(detection_table(spark, sf_dir))


@query
def reliability_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.reliability_metrics(R.replayed(spark, sf_dir), "row_idx", "reliability", F.col("onset"), METHOD_SEED))


def routing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.routing_metrics(R.replayed(spark, sf_dir), R.RUN, "action", "cloud_fallback", METHOD_SEED)


@query
def routing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(routing_table(spark, sf_dir))


@query
def hybrid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.hybrid_metrics(routing_table(spark, sf_dir), METHOD_SEED))


@query
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.latency_summary(E.execution_log(spark, sf_dir), "cloud_latency_s", ["selected_action"]))


@query
def latency_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.latency_summary(E.execution_log(spark, sf_dir), "total_latency_s"))


@query
def execution_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.execution_reliability(E.execution_log(spark, sf_dir), ["selected_action", "seed"]))


@query
def delivery_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.delivery_metrics(E.execution_log(spark, sf_dir), ["seed"]))


def run_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of every run, as the execution log has it: a row takes its device's mean of the tiers that answered."""
    log = E.execution_log(spark, sf_dir).groupBy("series_id").agg(
        *[F.avg(f"{c}_latency_s").alias(f"{c}_mean") for c in ("edge", "network", "cloud")]
    )
    d = R.replayed(spark, sf_dir).join(log, "series_id")
    in_cloud = (F.col("action") == "CLOUD") | F.col("cloud_fallback")
    lat = F.when(F.col("action") != "CLOUD", F.col("edge_mean")).otherwise(F.lit(0.0)) + F.when(
        in_cloud, F.col("network_mean") + F.col("cloud_mean")
    ).otherwise(F.lit(0.0))
    return metrics.latency_summary(d.withColumn("latency_s", lat), "latency_s", METHOD_SEED)


@query
def latency_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(run_latency(spark, sf_dir))


@query
def ablation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.mean_by_configuration(pre_post(spark, sf_dir), routing_table(spark, sf_dir), run_latency(spark, sf_dir)))


@query
def confidence_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.confidence_interval(pre_post(spark, sf_dir), "post_accuracy", ["method"]))


@query
def paired_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.paired_by_seed(pre_post(spark, sf_dir), "ADAPTIVE", "STATIC", "post_f1"))


COMPARED = (("ADAPTIVE", "STATIC"), ("ADAPTIVE", "NO_DRIFT_SIGNAL"), ("STATIC", "EDGE_ONLY"), ("ADAPTIVE_RETRAINED", "ADAPTIVE"))


@query
def paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(paired_table(spark, sf_dir))


@query
def run_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pre_post(spark, sf_dir).join(routing_table(spark, sf_dir), METHOD_SEED)
    return metrics.run_consistency(d, ["pre_accuracy", "post_accuracy", "pre_f1", "post_f1"], ["post_mcc", "offloading_ratio", "delta_f1"])


# ---- monitoring ------------------------------------------------------------------------------------


@query
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(monitoring.telemetry_summary(E.execution_log(spark, sf_dir), ["series_id"]))


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alarmed(spark, sf_dir).withColumnRenamed("alarm", "drift_detected").drop("ts")
    p = detect.persistence_windowed(a, E.STREAM, "drift_detected", 20, 8)
    return E.execution_log(spark, sf_dir).join(p, list(ID))


@query
def monitoring_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(monitoring.monitoring_snapshot(monitored(spark, sf_dir), E.STREAM))


@query
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(monitoring.model_health(E.execution_log(spark, sf_dir), "row_idx", ["series_id"]))


# ---- feedback and adaptation ---------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reliable(spark, sf_dir).select(*ID, "edge_pred", "z_value", "z_k", "y", "smoothed_severity", "raw_severity")


def late_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels arrive k/4 rows late, views never get one, and some stamps are before the fact."""
    d = E.ordered(spark, sf_dir).where((F.col("role") == "inference") & (F.col("event_type") != "view"))
    delay = F.floor(F.col("k") / 4.0) - F.when(F.col("state") == 3, F.lit(3)).otherwise(F.lit(0))
    return d.select(*ID, F.col("y").alias("label"), (F.col("row_idx") + delay).cast("long").alias("arrival_index"))


@query
def delayed_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = feedback.delayed_feedback(answers(spark, sf_dir), late_labels(spark, sf_dir), E.STREAM)
    return d.select(*ID, "edge_pred", "label", "arrival_index", "is_labeled", "causal")


@query
def eligible_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 40 labels known at row 150 from a buffer of 100 observations."""
    d = feedback.delayed_feedback(answers(spark, sf_dir), late_labels(spark, sf_dir), E.STREAM)
    out = feedback.eligible_feedback(d, E.STREAM, F.lit(150), 40, 100)
    return out.select(*ID, "label", "arrival_index")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    d = feedback.delayed_feedback(rows.select(*ID), late_labels(spark, sf_dir), E.STREAM)
    return feedback.eligible_count_asof(rows, d, E.STREAM, 60)


@query
def eligible_count_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).select(*ID, "n_eligible")


@query
def adaptation_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = counted(spark, sf_dir).withColumn("is_persistent", F.col("raw_severity") > 0.3)
    d = feedback.adaptation_triggers(materialise(d, "eligible"), E.STREAM, min_severity=0.35, min_feedback=25, cooldown=50)
    return d.select(*ID, "fired", "state", "reason")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every firing as a deployment attempt, accepted when the severity is high enough."""
    d = counted(spark, sf_dir).withColumn("is_persistent", F.col("raw_severity") > 0.3)
    fired = feedback.adaptation_triggers(materialise(d, "eligible"), E.STREAM, min_severity=0.35, min_feedback=25, cooldown=30)
    nth = E.STREAM.running(
        materialise(fired.select(*ID, "fired", "smoothed_severity"), "fired"), sums={"attempt": F.col("fired").cast("long")}
    )
    return nth.where("fired").withColumn("attempt", F.col("attempt") - 1)


ATTEMPT = Axis(("series_id",), "attempt")


@query
def version_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = feedback.version_audit(attempts(spark, sf_dir), ATTEMPT, F.col("smoothed_severity") >= 0.45)
    return d.select("series_id", "attempt", "row_idx", "version", "parent_version", "active_version", "status")


@query
def version_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = feedback.version_audit(attempts(spark, sf_dir), ATTEMPT, F.col("smoothed_severity") >= 0.45)
    return feedback.active_versions(d, ATTEMPT)


@query
def adaptation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firings per series, with series that never fired."""
    hit = attempts(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("n"))
    every = E.ordered(spark, sf_dir).where(F.col("role") == "inference").select("series_id").distinct()
    n = F.coalesce("n", F.lit(0))
    return every.join(hit, "series_id", "left").select(
        "series_id", n.alias("adaptation_events_count"),
        F.when(n > 0, F.lit("TRIGGERED")).otherwise(F.lit("NOT TRIGGERED")).alias("adaptation_status"),
    )


PER_CLASS = {0: 194, 1: 6}


def baseline_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.normalised(spark, sf_dir).where(F.col("role") == "baseline_train")
    return feedback.stratified_sample(d, "y", PER_CLASS, uniform(42, "sample", F.col("event_id")))


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_sample(spark, sf_dir).select("event_id", "y")


#: What a retraining learns from, per device: the newest labels, from a buffer of that many observations.
NEWEST_LABELS, LABEL_BUFFER = 40, 100


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline sample and the labels that were known at each device's last retraining trigger."""
    base = baseline_sample(spark, sf_dir).select("z_value", "z_k", F.col("y").alias("label"))
    last = adapt.triggers(spark, sf_dir).groupBy("series_id").agg(F.max("trigger_idx").alias("as_of"))
    d = feedback.delayed_feedback(answers(spark, sf_dir), late_labels(spark, sf_dir), E.STREAM).join(last, "series_id")
    late = feedback.eligible_feedback(d, E.STREAM, F.col("as_of"), NEWEST_LABELS, LABEL_BUFFER).select("z_value", "z_k", "label")
    return feedback.training_union(base, late)


@query
def training_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = training_rows(spark, sf_dir)
    return tidy(d.groupBy("origin", "label").agg(F.count("*").alias("n"), F.avg("z_value").alias("mean_z")))


@query
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate and active rule judged per device on the validation role."""
    d = E.normalised(spark, sf_dir)
    return tidy(
        feedback.candidate_gate(
            d.withColumn("candidate_pred", (F.col("z_k") > 0.8).cast("int")).withColumn("active_pred", (F.col("z_value") > 0.5).cast("int")),
            label="y", by=["series_id"], role="role", minimum=0.45, margin=0.05,
        )
    )


# ---- models -----------------------------------------------------------------------------------------------

FEATURES = ["z_value", "z_k", "state"]


@query
def edge_model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class statistics learned device by device and merged."""
    d = E.normalised(spark, sf_dir).withColumn("state", F.col("state").cast("double"))
    low, high = (models.causal_fit_data(d.where(part), FEATURES, "y") for part in ("series_id < 8", "series_id >= 8"))
    return tidy(models.nb_merge([models.nb_fit(low, FEATURES, "y"), models.nb_fit(high, FEATURES, "y")]))


def edge_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.normalised(spark, sf_dir)
    model = models.nb_fit(models.causal_fit_data(d, FEATURES, "y"), FEATURES, "y")
    val = d.where(F.col("role") == "baseline_validation").select("event_id", "y", *FEATURES)
    return models.predict(val, models.nb_scorer(model, FEATURES))


@query
def edge_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(edge_scored(spark, sf_dir).select("event_id", "p1"))


def edge_tree_grown(spark: SparkSession, sf_dir: str) -> trees.Tree:
    """The incremental tree of the training role, learned in two batches of devices."""
    tree = trees.Tree(trees.Settings(("z_value", "z_k"), "y", depth=3))
    for part in (0, 1):
        rows = E.normalised(spark, sf_dir).where(F.col("series_id") % 2 == part)
        tree = trees.learn(tree, models.causal_fit_data(rows, FEATURES, "y"))
    return tree


@query
def edge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the incremental tree."""
    return trees.node_table(edge_tree_grown(spark, sf_dir), E.normalised(spark, sf_dir))


@query
def edge_tree_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of every split of the root."""
    d = models.causal_fit_data(E.normalised(spark, sf_dir), FEATURES, "y")
    stats = trees.counted(d, [()], trees.Settings(("z_value", "z_k"), "y"))
    return tidy(trees.gains(stats).select("feature", "bin", "gain", "n", "positive"))


@query
def edge_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree on the validation role."""
    val = E.normalised(spark, sf_dir).where(F.col("role") == "baseline_validation").select("event_id", "y", *FEATURES)
    scored = trees.scorer(edge_tree_grown(spark, sf_dir))(val)
    return tidy(metrics.classification_metrics(scored.withColumn("prediction", (F.col("p1") >= 0.5).cast("int")), "y", "prediction"))


@query
def cloud_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees fit on the training role, scored on the validation role."""
    d = E.normalised(spark, sf_dir)
    fit = models.gbt_fit(models.causal_fit_data(d, FEATURES, "y"), FEATURES, "y", trees=20)
    val = d.where(F.col("role") == "baseline_validation").select("event_id", "y", *FEATURES)
    return tidy(models.predict(val, models.gbt_scorer(fit, FEATURES)).select("event_id", "y", "p1", "prediction"))


@query
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes and the fixed linear rule on the validation role."""
    nb = edge_scored(spark, sf_dir).select(F.lit("edge").alias("model"), "y", "prediction")
    val = E.normalised(spark, sf_dir).where(F.col("role") == "baseline_validation")
    rule = models.predict(val, models.logistic_scorer(E.CLOUD_WEIGHTS)).select(F.lit("cloud").alias("model"), "y", "prediction")
    return tidy(metrics.classification_metrics(nb.unionByName(rule), "y", "prediction", ["model"]))


@query
def causal_fit_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = models.causal_fit_data(E.normalised(spark, sf_dir), FEATURES, "y")
    return tidy(d.groupBy("y", "state").agg(F.count("*").alias("n"), F.avg("z_value").alias("mean_z")))


@query
def retrain_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate fit on baseline sample and late labels, with what it was fit on."""
    rows = materialise(training_rows(spark, sf_dir), "training")
    fit = models.gbt_fit(rows, ["z_value", "z_k"], "label", trees=10, depth=3)
    scored = models.predict(rows, models.gbt_scorer(fit, ["z_value", "z_k"]))
    return tidy(scored.groupBy("origin").agg(F.count("*").alias("samples"), F.avg("p1").alias("mean_p1")))


@query
def retrain_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that candidate is fit on, or that it is refused for fewer than 25 labels."""
    return feedback.retraining(materialise(training_rows(spark, sf_dir), "training"), ["z_value", "z_k"], "v2", "v1", 42)


# ---- all result tables ------------------------------------------------------------------------------------------


def paired_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialise(pre_post(spark, sf_dir), "prepost")
    pairs = None
    for a, b in COMPARED:
        one = metrics.paired_by_seed(table, a, b, "post_f1").withColumn("comparison", F.lit(f"{a} vs {b}"))
        pairs = one if pairs is None else pairs.unionByName(one)
    return metrics.paired_test(pairs, ["comparison"])


def detection_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["seed", "series_id"]
    return metrics.drift_metrics(
        detected(spark, sf_dir), "row_idx", "drift_detected", "is_persistent", "smoothed_severity", F.col("onset"), by
    )


RESULT_TABLES = {
    "baseline_model_metrics": lambda spark, sf: model_comparison(spark, sf),
    "drift_metrics": detection_table,
    "reliability_metrics": lambda spark, sf: reliability_metrics(spark, sf),
    "routing_metrics": routing_table,
    "hybrid_metrics": lambda spark, sf: hybrid_metrics(spark, sf),
    "prediction_metrics": pre_post,
    "adaptation_metrics": lambda spark, sf: adaptation_cycles(spark, sf),
    "latency_metrics": run_latency,
    "network_metrics": lambda spark, sf: delivery_metrics(spark, sf),
    "execution_metrics": lambda spark, sf: execution_reliability(spark, sf),
    "model_version_metrics": lambda spark, sf: feedback.active_versions(adapt.cycles(spark, sf), ATTEMPT),
    "ablation_metrics": lambda spark, sf: ablation_rollup(spark, sf),
    "statistical_results": paired_table,
}


@query
def sink_result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen result tables written to their folders, then counted from what was written."""
    root = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    made = {name: build(spark, sf_dir) for name, build in RESULT_TABLES.items()}
    sinks.write_tables(made, root, METHOD_SEED)
    out = None
    for name in made:
        one = tables.scan_parquet(spark, f"{root}/{name}").agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- flagship -----------------------------------------------------------------------------------------------


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing shares, switches and reliability per device of the hysteresis controller."""
    d = materialise(routed(spark, sf_dir, count_switches=False).select(*ID, "action", "reliability", "smoothed_severity"), "routed")
    shares = metrics.routing_metrics(d, E.STREAM)
    level = d.groupBy("series_id").agg(F.avg("reliability").alias("mean_reliability"), F.max("smoothed_severity").alias("max_severity"))
    return tidy(
        shares.join(level, "series_id").select(
            "series_id", "total_decisions", "edge_count", "cloud_count", "hybrid_count", "offloading_ratio",
            "switch_count", "mean_reliability", "max_severity",
        )
    )


@query
def adaptation_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every retraining attempt with its scores, verdict and the versions around it."""
    d = adapt.cycles(spark, sf_dir)
    return tidy(
        d.select(
            "series_id", "attempt", "trigger_idx", "candidate_metric", "active_metric", "accepted", "version",
            "parent_version", "active_version", "status",
        )
    )


@query
def adapted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows answered by the version in force."""
    return tidy(adapt.adapted_answers(spark, sf_dir))


@query
def adapted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the inference stream per version in force."""
    return tidy(metrics.classification_metrics(adapt.adapted_answers(spark, sf_dir), "y", "prediction", ["model_version"]))


# ---- streaming ------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/data", f"{root}/state"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event file as a stream of inference rows."""
    schema = tables.scan_parquet(spark, f"{sf_dir}/events.parquet").schema
    return inference_events(stateful.file_stream(spark, sf_dir, schema, "events.parquet"))


def inference_events(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return raw.where(F.col("ts") >= F.lit(E.VALIDATION_END).cast("timestamp_ntz")).select(
        (F.col("user_id") % 16).alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        "event_type", "value", k.alias("k"),
    )


def closed_stream(spark: SparkSession, stream: DataFrame, ts: str = "ts") -> DataFrame:
    """The stream and a closing row, so that the watermark passes everything in it."""
    folder, _ = scratch(spark, "closing")
    row = spark.createDataFrame([], stream.schema)
    ordered.closing(row, ts).write.parquet(folder)
    return stream.unionByName(stateful.file_stream(spark, folder, stream.schema))


@query
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online count windows over the value channel, cut from rows in order."""
    s = closed_stream(spark, event_stream(spark, sf_dir))
    out = stateful.run_to_table(ordered.ordered_windows(s, ["series_id"], "ts", "event_id", "value", 20, 5, "1 hour"), *scratch(spark, "stream-windows"))
    return tidy(out.select("series_id", "start_index", "end_index", "mean", "minimum", "maximum", "is_late"))


@query
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online detector, persistence and severity on the k channel."""
    s = event_stream(spark, sf_dir).withColumn("signal", F.col("k") / 100.0)
    out = stateful.run_to_table(
        stateful.detect_stream(s, ["series_id"], ["ts", "event_id"], "signal", 0.5, clock=8), *scratch(spark, "stream-detect")
    )
    return tidy(out.drop("ts"))


@query
def stream_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that overlap by days, put in order: every row under the number that the whole table gives it."""
    folder, _ = scratch(spark, "shuffled")
    src = inference_events(tables.scan_parquet(spark, f"{sf_dir}/events.parquet"))
    days = F.datediff("ts", F.lit(E.VALIDATION_END))
    for k in range(5):
        src.where(F.floor(days / 4) + F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(folder)
    ordered.closing(src, "ts").write.mode("append").parquet(folder)  # the last delivery: it would make all after it late
    s = stateful.file_stream(spark, folder, src.schema, files_per_trigger=1)
    out = stateful.run_to_table(ordered.ordered_stream(s, ["series_id"], "ts", "event_id", "9 days"), *scratch(spark, "stream-order"))
    return out.where("series_id >= 0").select("series_id", "row_idx", "event_id", "is_late")


@query
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries drained one after the other, the later days first: rows behind the stream come out as late."""
    folder, state = scratch(spark, "stream-order")
    src = tables.scan_parquet(spark, f"{sf_dir}/events.parquet")
    cut = F.lit("2024-01-23").cast("timestamp_ntz")
    for delivery in (F.col("ts") >= cut, F.col("ts") < cut):
        src.where(delivery).write.mode("append").parquet(folder)
        raw = stateful.file_stream(spark, folder, src.schema)
        s = raw.select((F.col("user_id") % 16).alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
        windows = stateful.window_stream(s, ["series_id"], ["ts", "event_id"], "value", 1, 1)
        out = stateful.run_to_table(windows, f"{folder}-out", state)
    return out.groupBy("series_id").agg(F.count_if(~F.col("is_late")).alias("n_folded"), F.count_if("is_late").alias("n_late"))


@query
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online totals of the execution log."""
    log = E.execution_log(spark, sf_dir)
    folder, _ = scratch(spark, "execution-log")
    log.write.parquet(folder)
    stream = stateful.file_stream(spark, folder, log.schema, files_per_trigger=1)
    return tidy(stateful.run_updates(stateful.monitor_stream(stream, ["series_id"]), *scratch(spark, "stream-monitor"), ["series_id"]))


def telemetry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The execution log with the 25 columns of a telemetry row beside its keys."""
    log = E.execution_log(spark, sf_dir)
    log = E.STREAM.bounded(log, {"previous_action": lambda w: F.lag("selected_action").over(w)}, back=1)
    seen = monitored(spark, sf_dir).select(*ID, "reliability", "drift_detected", "is_persistent", "raw_severity", "smoothed_severity")
    rel = E.reliable(spark, sf_dir).select(*ID, "ts", "confidence", "error_ema", "quality", F.col("edge_pred").alias("prediction"))
    d = log.join(seen, list(ID)).join(rel, list(ID)).withColumns({
        "observation_index": F.col("row_idx"), "timestamp": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "drift_severity": F.col("smoothed_severity"),
        "decision_reason": F.concat(F.lit("event type of "), F.col("model_used")), "model_version": F.lit("v1"), "controller_policy": F.lit("event_type"),
        "hybrid_latency_s": F.when(F.col("selected_action") == "HYBRID", F.col("total_latency_s")),
    })
    return d.select(*ID, "success", *monitoring.TELEMETRY_COLUMNS)


def monitor_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Alerts and newest rows of the telemetry, delivered in two parts (drained once)."""

    def build() -> DataFrame:
        rows = materialise(telemetry_rows(spark, sf_dir), "telemetry")
        folder, state = scratch(spark, "telemetry-log")
        for half in (0, 1):
            rows.where(F.col("row_idx") % 2 == half).coalesce(1).write.mode("append").parquet(folder)
        names = checks.alerts(
            F.col("reliability"), F.col("drift_detected"), F.col("is_persistent"), F.col("smoothed_severity"), ~F.col("success"), F.col("cloud_fallback"),
            F.col("packet_lost"), severity_floor=0.35,
        )
        watch = stateful.Monitor(f"{folder}-out", ["series_id"], "row_idx", 5, names)
        alerts, newest = watch.run(stateful.file_stream(spark, folder, rows.schema, files_per_trigger=1), state)
        told = alerts.withColumn("kind", F.lit("alert")).unionByName(newest.withColumn("kind", F.lit("newest")), allowMissingColumns=True)
        return materialise(told, "monitor")

    told = E.staged(spark, sf_dir, "monitor", build)
    return told.where("kind = 'alert'"), told.where("kind = 'newest'")


@query
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts raised online, per device and kind."""
    return monitor_run(spark, sf_dir)[0].groupBy("series_id", "alert").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))


@query
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five telemetry rows of every device, as the monitor holds them."""
    return tidy(monitor_run(spark, sf_dir)[1].select("series_id", *monitoring.TELEMETRY_COLUMNS))


def feedback_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions, and labels that arrive k hours later; both streams end with a closing row."""
    s = closed_stream(spark, event_stream(spark, sf_dir))
    predictions = s.select("event_id", "ts", (F.col("value") > 60).cast("int").alias("prediction"))
    labels = s.where(F.col("event_type") != "view").select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("ts") + F.make_dt_interval(hours=F.col("k").cast("int"))).alias("arrival_ts"),
    )
    return predictions, labels


@query
def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction with the label that arrived k hours later, 72 hours at most, or without one once none can come."""
    joined = stateful.feedback_stream(*feedback_sides(spark, sf_dir), ["event_id"], "72 HOURS", how="left_outer")
    out = stateful.run_to_table(joined, *scratch(spark, "stream-feedback")).where("event_id >= 0")
    return tidy(out.select("event_id", "prediction", "label", "arrival_ts", F.col("label").isNotNull().alias("is_labeled")))


@query
def stream_feedback_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that came too late for their predictions, in a table of their own."""
    joined = stateful.feedback_stream(*feedback_sides(spark, sf_dir), ["event_id"], "72 HOURS", how="full_outer")
    out = stateful.run_to_table(joined, *scratch(spark, "stream-late"))
    return tidy(out.where(F.col("prediction").isNull() & (F.col("event_id") >= 0)).select("event_id", "label", "arrival_ts"))
