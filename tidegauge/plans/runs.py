"""Experiment runs: every method and seed, and every drift strength, replays the stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import signals
from tidegauge.operators import inject
from tidegauge.operators.detect import severity_ema
from tidegauge.operators.ordering import SPREAD, Axis, series_waves, with_length
from tidegauge.operators.profile import apply_frozen
from tidegauge.operators.routing import closed_loop
from tidegauge.plans import adapt, events
from tidegauge.session import materialise, passing

SEEDS = (42, 43, 44, 45, 46)
# How each compared method routes and whether it sees the drift signal.
METHODS = {
    "EDGE_ONLY": ("edge_only", True),
    "CLOUD_ONLY": ("cloud_only", True),
    "STATIC": ("edge_only", True),
    "NO_DRIFT_SIGNAL": ("adaptive", False),
    "ADAPTIVE": ("adaptive", True),
    "ADAPTIVE_RETRAINED": ("adaptive", True),
}
MAGNITUDE, ONSET = 2.0, 0.5
# Drift strengths in baseline sigma and numbers of drifted channels to sweep.
MAGNITUDES, BREADTHS = (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0), (1, 2)
SEEDED = Axis(("seed", "series_id"))
RUN = Axis(("method", "seed", "series_id"))
#: Chunks are small, as every row of the stream stands for one of every strength and breadth in a task.
SWEPT = Axis(("magnitude", "breadth", "series_id"), chunk_rows=1 << 16)
FADE = 0.8
#: What is read of a run; nothing else of a row is written for every method and seed.
KEPT = (
    "method", "seed", "series_id", "row_idx", "label", "is_post", "onset", "signal", "raw_severity", "smoothed_severity", "confidence",
    "error_ema", "reliability", "action", "prediction", "cloud_fallback",
)
#: Rows of a series that are written side by side with those of all methods.
SIDE_BY_SIDE = 1 << 16


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "seed int")


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, p, d) for m, (p, d) in METHODS.items()], "method string, policy string, sees_drift boolean"
    )


def strengths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, b) for m in MAGNITUDES for b in BREADTHS], "magnitude double, breadth int")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference rows with the baseline's moments and the length of their series."""
    base = events.ordered(spark, sf_dir).where(F.col("role") == "inference")
    return with_length(apply_frozen(base, events.baseline_moments(spark, sf_dir)), events.STREAM, "n_stream")


def drifted(spark: SparkSession, sf_dir: str, among: Column) -> DataFrame:
    """Inference rows of the devices `among` x seeds with noise drift from the middle of each series on.

    The grid is a fixed handful of rows, so the cross join multiplies the stream by that
    many runs and nothing else; each run is its own series from here on.
    """
    grid = stream(spark, sf_dir).where(among).crossJoin(F.broadcast(seeds(spark)))
    level = inject.schedule("sudden", MAGNITUDE, F.col("row_idx"), F.col("n_stream"), ONSET)
    return inject.inject(
        grid, events.CONTINUOUS, level, "noise", expansion=1.5, key=["event_id"], seed=F.col("seed")
    )


def scored(spark: SparkSession, sf_dir: str, moved: DataFrame, axis: Axis) -> DataFrame:
    """Severity, confidence and both tiers' answers of drifted rows, per run of `axis`."""
    run = [c for c in axis.series if c != "series_id"]
    z = lambda c: (F.col(f"{c}__drifted") - F.col(f"{c}__mean")) / F.greatest(F.col(f"{c}__std"), F.lit(1e-8))
    d = moved.select(
        *run, "series_id", "row_idx", "event_id", "y", "n_stream", *[z(c).alias(f"z_{c}") for c in events.CONTINUOUS],
        *[c for c in SPREAD if c in moved.columns],
    )
    d = apply_frozen(d, events.baseline_signal_mean(spark, sf_dir))
    d = d.withColumn("signal", signals.winsorized_l1([F.col("z_value"), F.col("z_k")]))
    raw = signals.raw_severity(F.col("signal"), F.col("baseline_mean"), max_shift=1.0)
    d = severity_ema(d, axis, raw, FADE)
    p1, c1 = events.probability(events.EDGE_WEIGHTS), events.probability(events.CLOUD_WEIGHTS)
    conf = signals.confidence(F.lit(1.0) - p1, p1)
    onset = F.bround(F.col("n_stream") * ONSET)
    return d.select(
        *run, "series_id", "row_idx", "event_id", F.col("y").alias("label"),
        (F.col("row_idx") >= onset).alias("is_post"), onset.cast("long").alias("onset"),
        "signal", "raw_severity", "smoothed_severity", "z_value", "z_k",
        conf.alias("confidence"), conf.alias("edge_conf"), F.lit(1.0).alias("quality"),
        (p1 >= 0.5).cast("int").alias("edge_pred"), (c1 >= 0.5).cast("int").alias("cloud_pred"),
    )


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs with severity, closed-loop reliability, action and answer per row (written once).

    The retrained method is the adaptive one whose cloud model changes: see `adapt.retrained`. Devices are replayed range by
    range, as everything but what is kept of a run is needed for as long as its device is replayed only.
    """

    def replay(devices: Column, last: int) -> DataFrame:
        with passing(spark, "runs"):
            with passing(spark, "retrained"):
                one = scored(spark, sf_dir, drifted(spark, sf_dir, devices), SEEDED).drop("event_id", "edge_conf", "quality")
                one = materialise(one.withColumnRenamed("label", "y"), "drifted")
                rule = (events.probability(events.CLOUD_WEIGHTS) >= 0.5).cast("int")
                one = materialise(adapt.retrained(spark, sf_dir, one, SEEDED, rule, devices).withColumnRenamed("y", "label"), "retrained")
            grid = one.crossJoin(F.broadcast(methods(spark)))
            in_cloud = F.when(F.col("method") == "ADAPTIVE_RETRAINED", F.col("retrained_pred")).otherwise(F.col("cloud_pred"))
            seen: Column = F.when(F.col("sees_drift"), F.col("smoothed_severity")).otherwise(F.lit(0.0))
            grid = grid.withColumns({"cloud_pred": in_cloud, "drift": seen, "edge_conf": F.col("confidence"), "quality": F.lit(1.0)})
            loop = closed_loop(grid.drop("retrained_pred", "z_value", "z_k", "sees_drift"), RUN, events.LABEL_DELAY, last_index=last).select(*KEPT)
            # A row's methods lie side by side: most of their values are equal and take no room.
            near = F.floor(F.col("row_idx") / F.lit(SIDE_BY_SIDE))
            loop = loop.repartition("seed", "series_id", near).sortWithinPartitions("seed", "series_id", "row_idx", "method")
            return materialise(loop, "runs")

    def build() -> DataFrame:
        every = events.ordered(spark, sf_dir).where(F.col("role") == "inference")
        last = events.last_index(spark, sf_dir)
        return reduce(DataFrame.unionByName, [replay(devices, last) for devices in series_waves(every, "series_id")])

    return events.staged(spark, sf_dir, "runs", build)


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive method under offsets of every strength and breadth (written once).

    Channels drift in order of baseline variance: breadth 1 moves `value`, 2 moves `k` too.
    """

    def build() -> DataFrame:
        grid = SWEPT.spread(stream(spark, sf_dir), FADE, ["series_id"]).crossJoin(F.broadcast(strengths(spark)))
        level = inject.schedule("sudden", 1.0, F.col("row_idx"), F.col("n_stream"), ONSET) * F.col("magnitude")
        d = inject.inject(grid, events.CONTINUOUS, level, "offset", expansion=4.0)
        kept = F.when(F.col("breadth") >= 2, F.col("k__drifted")).otherwise(F.col("k"))
        one = scored(spark, sf_dir, d.withColumn("k__drifted", kept), SWEPT)
        # What the loop and the table of the sweep read, and nothing else, for every strength and breadth.
        ready = one.select(
            *SWEPT.series, SWEPT.idx, "onset", "label", "confidence", F.col("smoothed_severity").alias("drift"), "quality", "edge_pred",
            "cloud_pred", "edge_conf", F.lit("adaptive").alias("policy"),
        )
        last = events.last_index(spark, sf_dir)
        return materialise(closed_loop(ready, SWEPT, events.LABEL_DELAY, last_index=last), "sweep")

    return events.staged(spark, sf_dir, "sweep", build)
