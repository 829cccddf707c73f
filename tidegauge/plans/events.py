"""The event table as sensor telemetry: channels, roles, order, frozen statistics, signals.

`events` is read as a stream of readings per device (`series_id`), with two continuous
channels (value, k), one discrete channel (state) and a late label (y). The first ten days
are the training baseline, the next five the validation span, the rest the inference stream.
Each (device, role) is an ordered series of its own, as each role is replayed separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import signals
from tidegauge.operators.detect import severity_ema
from tidegauge.operators.ordering import Axis, causal_order
from tidegauge.operators.profile import apply_frozen, fit_statistics, moments, wide_statistics
from tidegauge.operators.quality import normalize_frozen
from tidegauge.operators.routing import delayed_error
from tidegauge.session import lasting, materialise
from tidegauge.sources.tables import assign_role, scan_parquet

TRAIN_END, VALIDATION_END = "2024-01-11", "2024-01-16"
SERIES = ("series_id", "role")
CONTINUOUS, DISCRETE = ("value", "k"), ("state",)
AXIS = Axis(SERIES)
STREAM = Axis(("series_id",))
EDGE_WEIGHTS = {"z_value": 0.8, "z_k": -0.2}
CLOUD_WEIGHTS = {"z_value": 1.5, "z_k": -0.6}
LABEL_DELAY = 15

_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A written intermediate table, built once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        with lasting():
            _STAGED[key] = build()
    return _STAGED[key]


def forget() -> None:
    """Drop the references to staged tables, so the next use builds them again."""
    _STAGED.clear()


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return scan_parquet(spark, f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 16).alias("series_id"),
        "event_id",
        "ts",
        "user_id",
        "event_type",
        signals.nan_to_null(F.col("value")).alias("value"),
        k.alias("k"),
        (k.cast("int") % 4).alias("state"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        # A channel that reports on purchases only, so it has holes.
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        assign_role(F.col("ts"), TRAIN_END, VALIDATION_END).alias("role"),
    )


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry numbered by (ts, event_id) within each (device, role)."""
    return staged(
        spark, sf_dir, "ordered", lambda: causal_order(telemetry(spark, sf_dir), SERIES, ("ts", "event_id"))
    )


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen statistics of the training baseline, one row per continuous channel."""
    base = telemetry(spark, sf_dir).where(F.col("role") == "baseline_train")
    return fit_statistics(base, CONTINUOUS)


def frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's statistics as one row, fit once and written: frozen from then on."""
    return staged(
        spark, sf_dir, "frozen",
        lambda: materialise(wide_statistics(statistics(spark, sf_dir), CONTINUOUS), "frozen"),
    )


def with_statistics(spark: SparkSession, sf_dir: str, df: DataFrame | None = None) -> DataFrame:
    return apply_frozen(ordered(spark, sf_dir) if df is None else df, frozen(spark, sf_dir))


def baseline_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the training baseline as one written row: what normalisation and injection need."""

    def build() -> DataFrame:
        base = telemetry(spark, sf_dir).where(F.col("role") == "baseline_train")
        return materialise(moments(base, CONTINUOUS), "moments")

    return staged(spark, sf_dir, "moments", build)


def with_z(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    d = apply_frozen(df, baseline_moments(spark, sf_dir))
    return d.select(*df.columns, *[normalize_frozen(c).alias(f"z_{c}") for c in CONTINUOUS])


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered telemetry with frozen z-scores z_value and z_k."""
    return with_z(spark, sf_dir, ordered(spark, sf_dir))


def probability(weights: dict[str, float]):
    logit = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference rows with probabilities of both tiers, the drift signal and the edge answer."""
    d = with_z(spark, sf_dir, ordered(spark, sf_dir).where(F.col("role") == "inference"))
    p1, c1 = probability(EDGE_WEIGHTS), probability(CLOUD_WEIGHTS)
    return d.select(
        "series_id", "role", "row_idx", "event_id", "ts", "y", "z_value", "z_k",
        (F.lit(1.0) - p1).alias("p0"), p1.alias("p1"),
        (F.lit(1.0) - c1).alias("cloud_p0"), c1.alias("cloud_p1"),
        (p1 >= 0.5).cast("int").alias("edge_pred"),
        (c1 >= 0.5).cast("int").alias("cloud_pred"),
        signals.winsorized_l1([F.col("z_value"), F.col("z_k")]).alias("signal"),
    )


def baseline_signal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean drift signal over the training baseline: one row. A mean needs no order."""

    def build() -> DataFrame:
        base = with_z(spark, sf_dir, telemetry(spark, sf_dir).where(F.col("role") == "baseline_train"))
        mean = F.avg(signals.winsorized_l1([F.col("z_value"), F.col("z_k")]))
        return materialise(base.agg(mean.alias("baseline_mean")), "signal-mean")

    return staged(spark, sf_dir, "signal_mean", build)


def with_raw_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = apply_frozen(scored(spark, sf_dir), baseline_signal_mean(spark, sf_dir))
    return d.withColumn("raw_severity", signals.raw_severity(F.col("signal"), F.col("baseline_mean"), max_shift=1.0))


def with_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with raw and smoothed severity."""
    return severity_ema(with_raw_severity(spark, sf_dir), STREAM, F.col("raw_severity"), 0.8)


def reliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with confidence, late-label error, severity and reliability (written once).

    Severity and error are smoothed in the same shuffle.
    """

    def build() -> DataFrame:
        loss = signals.zero_one_loss(F.col("edge_pred"), F.col("y"))
        severity = {"smoothed_severity": (F.col("raw_severity"), None)}
        d = delayed_error(with_raw_severity(spark, sf_dir), severity, loss, STREAM, LABEL_DELAY)
        conf = signals.confidence(F.col("p0"), F.col("p1"))
        quality = signals.quality_score([F.col("z_value").isNotNull(), F.col("z_k").isNotNull()])
        r = signals.harmonic_reliability(
            F.col("confidence"), F.col("error_ema"), F.col("smoothed_severity"), F.col("quality")
        )
        done = d.withColumn("confidence", conf).withColumn("quality", quality).withColumn("reliability", r)
        return materialise(done, "reliable")

    return staged(spark, sf_dir, "reliable", build)


def last_index(spark: SparkSession, sf_dir: str) -> int:
    """Largest row index of any inference series: one number from the ordered table."""
    d = ordered(spark, sf_dir).where(F.col("role") == "inference")
    return d.agg(F.max("row_idx")).first()[0] or 0


def execution_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An execution log read off the inference events: who answered, how long it took, what failed.

    The event type stands for the chosen action, the channels for latencies and faults.
    """
    kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
    action = (
        F.when(kind.isin("click", "view"), F.lit("EDGE"))
        .when(kind == "purchase", F.lit("CLOUD"))
        .otherwise(F.lit("HYBRID"))
    )
    act = F.col("selected_action")
    fallback = (act == "HYBRID") & (k < 40)
    in_cloud = (act == "CLOUD") | F.col("cloud_fallback")
    lost = in_cloud & (F.col("state") == 3) & (value < 30)
    status = F.when(~F.col("success"), F.lit("FAILED")).when(F.col("cloud_fallback"), F.lit("FALLBACK")).otherwise(F.lit("SUCCESS"))
    used = (
        F.when(act == "EDGE", F.lit("edge"))
        .when(act == "CLOUD", F.lit("cloud"))
        .when(F.col("cloud_fallback"), F.lit("hybrid_cloud"))
        .otherwise(F.lit("hybrid_edge"))
    )
    d = ordered(spark, sf_dir).where(F.col("role") == "inference")
    return (
        d.select("series_id", "row_idx", "event_id", "user_id", "value", "k", "state", action.alias("selected_action"))
        .withColumn("cloud_fallback", fallback)
        .withColumn("packet_lost", lost)
        .withColumn("success", ~F.col("packet_lost") & (value <= 150))
        .withColumn("edge_latency_s", F.when(act != "CLOUD", value / 1000.0))
        .withColumn("network_latency_s", F.when(in_cloud, k / 1000.0))
        .withColumn("cloud_latency_s", F.when(in_cloud & ~F.col("packet_lost"), value / 500.0))
        .withColumn("model_used", used)
        .withColumn("execution_status", status)
        .withColumn(
            "error",
            F.when(F.col("packet_lost"), F.lit("network failure: packet lost")).when(~F.col("success"), F.lit("model failure")),
        )
        .withColumn(
            "total_latency_s",
            sum((F.coalesce(c, F.lit(0.0)) for c in ("edge_latency_s", "network_latency_s", "cloud_latency_s")), F.lit(0.0)),
        )
        .withColumn("seed", (F.col("user_id") % 5).cast("int"))
    )
