"""Named queries over the driver's tables: scans, checks, profiles, order, quality, drift."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import checks
from tidegauge.operators import audit, inject, ordering, profile, quality, windows
from tidegauge.operators.models import causal_fit_data
from tidegauge.operators.monitoring import running_counters as count_running
from tidegauge.operators.ordering import Axis
from tidegauge.plans import events as E
from tidegauge.session import materialise, shared_dir
from tidegauge.sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FLOW_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
FLOW_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
FLOW = Axis(("stream",))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), time stamps as text: comparable across engines.

    Means of decimal data often lie exactly half-way between two rounded values, where the
    last bit of a sum would decide; a tiny shift decides them upwards in every engine.
    """
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(1e-10), digits) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(c.alias(name))
    return df.select(*cols)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a flow table: one global stream with many rows per time stamp."""
    return tables.scan_parquet(spark, f"{sf_dir}/lineitem.parquet").withColumn("stream", F.lit("flow"))


def flow_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.staged(
        spark, sf_dir, "flow", lambda: ordering.causal_order(flow(spark, sf_dir), ("stream",), FLOW_ORDER)
    )


def flow_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(flow(spark, sf_dir), FLOW_NUMBERS)


def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_statistics(spark, sf_dir).where(F.col("role") == "inference")


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered telemetry with gap blocks: a pause of more than twelve hours starts a new one."""
    return E.staged(
        spark, sf_dir, "blocked",
        lambda: E.materialise(ordering.gap_blocks(E.ordered(spark, sf_dir), E.AXIS, "ts", 43200.0), "blocked"),
    )


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.forward_fill(blocked(spark, sf_dir), E.AXIS, ["amount"], limit=3)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered telemetry with every quality flag."""
    d = E.with_statistics(spark, sf_dir, filled(spark, sf_dir))
    d = quality.outlier_flags(quality.range_check(d, E.CONTINUOUS, 2.0), E.CONTINUOUS, "iqr", 1.0)
    z = [quality.normalize_frozen(c) for c in E.CONTINUOUS]
    return d.withColumn("validation_failed", F.col("range_violation")).withColumn(
        "valid", quality.row_validity(F.col("unfilled"), z)
    )


def channel_flags() -> dict[str, Column]:
    return {f"{c}.{kind}": F.col(f"{c}__{kind}") for c in E.CONTINUOUS for kind in ("range", "outlier")}


# ---- scans, sources, sinks -------------------------------------------------------------


@query
def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as ';'-delimited text with padded header names, then scanned back."""
    path = f"{shared_dir(spark)}/delimited-{uuid.uuid4().hex}"
    src = tables.scan_parquet(spark, f"{sf_dir}/events.parquet")
    text = src.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" ts "), F.col("event_id").alias("event_id "), "event_type", "value")
    text.write.option("header", True).option("sep", ";").csv(path)
    schema = T.StructType().add("ts ", "string").add("event_id ", "long").add("event_type", "string").add("value", "double")
    back = tables.scan_delimited(spark, path, schema, ";", "ts")
    parsed = tables.parse_ts_strict(back, "ts", name="at")
    return tidy(
        parsed.groupBy("event_type").agg(
            F.count("*").alias("n"), F.sum("event_id").alias("id_sum"), F.avg("value").alias("mean_value"),
            F.min("at").alias("first_at"), F.count_if(F.col("at").isNull()).alias("n_unparsed"),
        )
    )


@query
def scan_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as text with a field missing, one too many or a word for a number in some lines, told apart by the scan."""
    path = f"{shared_dir(spark)}/broken-{uuid.uuid4().hex}"
    src = tables.scan_parquet(spark, f"{sf_dir}/events.parquet")
    fields = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string")]
    fault = F.col("event_id") % 50
    user = F.when(fault == 2, F.lit("many")).otherwise(fields[3])
    line = F.when(fault == 0, F.concat_ws(";", *fields[:3])).when(fault == 1, F.concat_ws(";", *fields, F.lit("more"))).otherwise(F.concat_ws(";", *fields[:3], user))
    src.select(line.alias("value")).write.text(path)
    schema = T.StructType().add("ts", "string").add("event_id", "long").add("event_type", "string").add("user_id", "long")
    good, bad = tables.scan_quarantined(spark, path, schema, ";", header=False)
    kept = good.agg(F.lit("kept").alias("reason"), F.count("*").alias("n"), F.sum("event_id").alias("id_sum"), F.lit(None).cast("string").alias("sample"))
    return kept.unionByName(bad.groupBy("reason").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("id_sum"), F.min("line").alias("sample")))


@query
def scan_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.time_range(E.telemetry(spark, sf_dir), "ts", "2024-01-05 00:00:00", "2024-01-12 12:00:00")
    return tidy(d.select("event_id", "ts", "value"))


@query
def scan_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ordering.row_cap(E.ordered(spark, sf_dir), "row_idx", 20).select(*E.SERIES, "row_idx", "event_id"))


@query
def split_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.role_counts(E.telemetry(spark, sf_dir))


@query
def extract_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in stream order; a text column that is mostly not a number counts as 0."""
    d = E.ordered(spark, sf_dir).withColumn("raw", F.when(F.col("y") == 1, F.lit("1")).when(F.col("state") == 0, F.lit("n/a")))
    return d.select(*E.SERIES, "row_idx", tables.extract_labels("raw").alias("label"))


@query
def sink_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window log written with its declared schema and read back."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    w = windows.emit(stream_windows_table(spark, sf_dir), E.AXIS, 5, True, 0.0)
    log = w.where(F.col("role") == "inference").select(*sinks.LOG_SCHEMAS["stream"])
    sinks.write_log(log, "stream", path)
    return spark.read.option("header", True).csv(path)


@query
def sink_event_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into the run log, a delivery at a time; the last delivery comes twice and counts once."""
    root = f"{shared_dir(spark)}/event-log-{uuid.uuid4().hex}"
    src = tables.scan_parquet(spark, f"{sf_dir}/events.parquet")
    for half in (0, 1):
        src.where(F.col("event_id") % 2 == half).coalesce(2).write.mode("append").parquet(f"{root}/in")
    raw = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    kind = F.col("event_type")
    log = raw.select(
        kind.alias("event"), F.lit("events").alias("config_name"), F.md5(kind).alias("config_fingerprint"), (F.col("user_id") % 5).alias("master_seed"),
        F.col("event_id").cast("string").alias("detail"),
    )
    sinks.write_log_stream(log, "run", f"{root}/log", f"{root}/state")
    sinks.replay_last(spark, "run", f"{root}/log")
    done = sinks.read_log_stream(spark, "run", f"{root}/log")
    return done.groupBy("event", "config_fingerprint", "master_seed").agg(F.count("*").alias("n"), F.sum(F.col("detail").cast("long")).alias("id_sum"))


@query
def sink_quality_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.quality_row(report(spark, sf_dir), "preprocess", "frozen baseline", ["role"])


@query
def sink_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injection facts written to their own JSON sidecar and read back."""
    path = f"{shared_dir(spark)}/truth-{uuid.uuid4().hex}"
    fields = [
        "scenario", "mechanism", "drift_start_index", "drift_end_index", "affected_features", "drift_magnitude", "realised_value", "realised_k", "random_seed", "notes",
    ]
    sinks.write_sidecar(truth(spark, sf_dir), path, fields)
    schema = "scenario string, mechanism string, drift_start_index long, drift_end_index long, affected_features string, drift_magnitude double"
    return tidy(spark.read.schema(f"{schema}, realised_value double, realised_k double, random_seed int, notes string").json(path))


# ---- projections, predicates, row checks -----------------------------------------------


@query
def parse_ts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strict format over stamps of which some carry a fraction and fail it."""
    d = E.telemetry(spark, sf_dir)
    shown = F.when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(
        F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    parsed = tables.parse_ts_strict(d.withColumn("raw", shown), "raw", name="at")
    return tables.unparsed(parsed, "raw", "at")


@query
def project_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature left after dropping time, label, identifiers and exclusions: its mean."""
    d = E.telemetry(spark, sf_dir)
    names = tables.feature_columns(d, ["ts", "y", "role"], ["event_id", "user_id", "series_id", "event_type", "amount"])
    return tidy(tables.long_features(d, [], names).groupBy("column").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query
def check_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flow(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")])
    return audit.check_numeric(d, d.columns)


@query
def missing_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_census(E.telemetry(spark, sf_dir), ["value", "k", "state", "amount", "event_type"])


@query
def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of the guarded feature set, counted per class."""
    d = E.normalised(spark, sf_dir)
    return causal_fit_data(d, ["z_value", "z_k"], "y").groupBy("y").agg(F.count("*").alias("n"))


@query
def leakage_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the telemetry with its values, and whether a feature set may name it."""
    d = E.normalised(spark, sf_dir)
    refused = set(checks.leakage_columns(d.columns))
    facts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n_values"), F.lit(c in refused).alias("is_refused")) for c in d.columns]
    return d.agg(F.array(*facts).alias("a")).select(F.inline("a"))


@query
def validate_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the problem of their feature vector; the amount has holes, 1/k an infinity."""
    d = E.telemetry(spark, sf_dir).withColumn("root", F.when(F.col("k") > 0, 1.0 / F.col("k")).otherwise(F.lit(float("inf"))))
    found = d.withColumn("error", F.coalesce(checks.validate_observation(["value", "root", "amount"], 3), F.lit("ok")))
    return found.groupBy("event_type", "error").agg(F.count("*").alias("n"))


@query
def validate_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with faults that follow from the data: shifted, missing or out-of-range values."""
    d = E.telemetry(spark, sf_dir)
    p1 = F.when(F.col("state") == 3, F.lit(None)).otherwise((F.col("k") + F.col("state") * 5) / 100.0)
    p0 = 1.0 - F.col("k") / 100.0 - F.when(F.col("event_type") == "click", F.lit(0.05)).otherwise(F.lit(0.0))
    pred = F.when(F.col("event_type") == "signup", F.lit(2)).otherwise(F.col("y"))
    found = d.select(F.coalesce(checks.validate_prediction(pred, p0, p1), F.lit("ok")).alias("error"))
    return found.groupBy("error").agg(F.count("*").alias("n"))


@query
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.range_check(E.with_statistics(spark, sf_dir), E.CONTINUOUS, 2.0)
    return d.groupBy("role").agg(
        F.count_if("range_violation").alias("n_rows"), *[F.count_if(f"{c}__range").alias(f"n_{c}") for c in E.CONTINUOUS]
    )


@query
def ts_order_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow rows in causal order by return flag: repeats of a ship date, never a step back."""
    axis = Axis(("l_returnflag",))
    d = ordering.causal_order(flow(spark, sf_dir), ("l_returnflag",), FLOW_ORDER)
    f = ordering.order_flags(d, axis, "l_shipdate")
    return f.groupBy("l_returnflag").agg(F.count_if("is_back").alias("n_back"), F.count_if("is_duplicate").alias("n_duplicate"))


@query
def ts_arrival_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow rows in order-key sequence: backward ship dates and repeats of one seen before."""
    axis = Axis(("l_returnflag",))
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    d = ordering.causal_order(flow(spark, sf_dir), ("l_returnflag",), order)
    f = ordering.arrival_order_flags(d, axis, "l_shipdate")
    return f.groupBy("l_returnflag").agg(F.count_if("is_back").alias("n_back"), F.count_if("is_duplicate").alias("n_duplicate"))


@query
def outlier_flags_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.outlier_flags(E.with_statistics(spark, sf_dir), E.CONTINUOUS, "iqr", 1.0)
    return d.where("outlier").select("event_id", "value__outlier", "k__outlier")


@query
def outlier_flags_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.outlier_flags(E.with_statistics(spark, sf_dir), E.CONTINUOUS, "zscore", 1.5)
    return d.where("outlier").select("event_id", "value__outlier", "k__outlier")


@query
def outlier_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.outlier_clip(E.with_statistics(spark, sf_dir), ["value"], "iqr", 0.5)
    return tidy(d.select("event_id", "value"))


@query
def degenerate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`flat` is constant for most baseline rows, so its quartiles coincide."""
    d = E.telemetry(spark, sf_dir).withColumn("flat", F.when(F.col("k") > 90, F.col("k")).otherwise(F.lit(1.0)))
    cols = ["value", "k", "flat"]
    stats = profile.fit_statistics(d.where(F.col("role") == "baseline_train"), cols)
    wide = profile.apply_frozen(d, profile.wide_statistics(stats, cols))
    return quality.degenerate_bounds(wide, cols)


@query
def row_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = report(spark, sf_dir)
    return d.groupBy("role").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if("outlier").alias("n_outlier"))


@query
def select_zero_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.telemetry(spark, sf_dir).select("value", "k", "state", F.lit(7).alias("fixed"), (F.col("state") * 0).alias("dead"))
    return profile.zero_variance_report(profile.profile_columns(d, d.columns), ["dead", "state"])


@query
def classify_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.classify_columns(flow_profile(spark, sf_dir), continuous=["l_tax"])


@query
def exclude_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.exclude_siblings(flow_profile(spark, sf_dir), "l_quantity", {"l_quantity": ["l_extendedprice"]})


@query
def resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved target's own profile row."""
    p = flow_profile(spark, sf_dir)
    name = profile.resolve_target(p, "l_linenumber", "classification")
    return p.where(F.col("column") == name).select("column", "n_unique", "is_discrete")


@query
def unit_interval_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.telemetry(spark, sf_dir).select(
        "event_type", (F.col("value") / 100.0).alias("a"), (F.col("k") / 50.0).alias("b"), (F.col("amount") / 400.0).alias("c")
    )
    return checks.unit_interval_violations(d, ["a", "b", "c"], ["event_type"])


# ---- baseline profile and frozen statistics ---------------------------------------------


@query
def profile_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.baseline_profile(E.telemetry(spark, sf_dir), ["value", "k", "state"]))


@query
def profile_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(flow_profile(spark, sf_dir), 4)


@query
def fit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.statistics(spark, sf_dir))


@query
def fit_statistics_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.fit_statistics(flow(spark, sf_dir), FLOW_NUMBERS), 4)


@query
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flow(spark, sf_dir)
    return tidy(profile.exact_quantiles(d, ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.95, 0.999], ["l_returnflag"]))


@query
def apply_frozen_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.normalised(spark, sf_dir).select("event_id", "z_value", "z_k"))


@query
def top_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.top_variance(flow_profile(spark, sf_dir), 2), 4)


@query
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_summary(report(spark, sf_dir), channel_flags(), 5, ["role"])


@query
def top_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_offenders(report(spark, sf_dir), channel_flags(), 3)


@query
def baseline_signal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.baseline_signal_mean(spark, sf_dir))


# ---- order, blocks, causal windows --------------------------------------------------------


@query
def causal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_ordered(spark, sf_dir).select("row_idx", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query
def gap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked(spark, sf_dir).select(*E.SERIES, "row_idx", "block_id")


@query
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(filled(spark, sf_dir).select(*E.SERIES, "row_idx", "amount", "filled", "unfilled"))


@query
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.trailing(blocked(spark, sf_dir), E.AXIS, {"smooth": "value"}, 5, "mean", "block_id")
    return tidy(d.select(*E.SERIES, "row_idx", "smooth"))


@query
def trailing_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.trailing(blocked(spark, sf_dir), E.AXIS, {"smooth": "value"}, 5, "median", "block_id")
    return tidy(d.select(*E.SERIES, "row_idx", "smooth"))


@query
def normalize_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.normalised(spark, sf_dir).select(*E.SERIES, "row_idx", "z_value", "z_k"))


@query
def normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.with_statistics(spark, sf_dir)
    return tidy(d.select("event_id", *[quality.normalize_minmax(c).alias(f"{c}_minmax") for c in E.CONTINUOUS]))


@query
def normalize_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.normalize_running(inference(spark, sf_dir), E.STREAM, E.CONTINUOUS)
    return tidy(d.select("series_id", "row_idx", "value__run", "k__run"))


def rolling(spark: SparkSession, sf_dir: str, stream: DataFrame, columns, width: int) -> DataFrame:
    base = E.ordered(spark, sf_dir).where(F.col("role") == "baseline_train").drop("role")
    tail = quality.baseline_tail(base, E.STREAM, list(E.CONTINUOUS), width)
    renamed = tail.withColumnsRenamed({o: n for o, n in zip(E.CONTINUOUS, columns) if o != n})
    return quality.normalize_rolling(stream, E.STREAM, renamed, columns, width)


@query
def normalize_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = E.ordered(spark, sf_dir).where(F.col("role") == "inference").select("series_id", "row_idx", *E.CONTINUOUS)
    return tidy(rolling(spark, sf_dir, stream, list(E.CONTINUOUS), 50).select("series_id", "row_idx", "value__roll", "k__roll"))


@query
def representative_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.representative_window(E.ordered(spark, sf_dir), E.AXIS, "y", 60, 7)


@query
def window_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts of the chosen window and its halves."""
    d = E.ordered(spark, sf_dir)
    best = windows.representative_window(d, E.AXIS, "y", 60, 7)
    inside = d.join(best, list(E.SERIES)).where(F.col("row_idx").between(F.col("start_index"), F.col("start_index") + 59))
    late = F.col("row_idx") >= F.col("start_index") + 30
    return tidy(
        inside.groupBy(*E.SERIES, "start_index").agg(
            (F.max("row_idx") + 1).alias("end_index"), F.count("*").alias("n_rows"),
            F.count_if(F.col("y") == 0).alias("class_0"), F.count_if(F.col("y") == 1).alias("class_1"),
            F.avg("y").alias("positive_rate"),
            F.count_if((F.col("y") == 1) & ~late).alias("pre_positives"), F.count_if((F.col("y") == 1) & late).alias("post_positives"),
        )
    )


@query
def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = count_running(E.execution_log(spark, sf_dir), E.STREAM)
    return d.select("series_id", "row_idx", "n_edge", "n_cloud", "n_hybrid", "n_switches", "n_failed")


@query
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ordering.recent_rows(E.ordered(spark, sf_dir), E.AXIS, 10).select(*E.SERIES, "row_idx", "event_id", "value"))


# ---- count windows and features -----------------------------------------------------------

SIZE, STEP = 20, 5


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with blocks, flags and validity, ready to be cut into windows."""
    d = report(spark, sf_dir)
    return d.select(
        *E.SERIES, "row_idx", "ts", "block_id", "outlier", "range_violation", (F.col("event_type") != "signup").alias("valid")
    )


def stream_windows_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windowed(spark, sf_dir)
    return windows.sliding_windows(d, E.AXIS, SIZE, STEP, ts="ts", block="block_id", valid="valid", flags=["outlier", "range_violation"])


@query
def window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = E.ordered(spark, sf_dir).groupBy(*E.SERIES).agg(F.count("*").alias("n_rows"))
    return windows.window_grid(lengths, SIZE, STEP)


@query
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.emit(stream_windows_table(spark, sf_dir), E.AXIS, STEP, True, 0.75)
    return tidy(w.select(*E.SERIES, "window_id", "start_index", "end_index", "start_time", "end_time", "valid_fraction"))


@query
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = E.ordered(spark, sf_dir).groupBy(*E.SERIES).agg(F.count("*").alias("n_rows"))
    return windows.window_stats(stream_windows_table(spark, sf_dir), lengths, E.AXIS, SIZE, STEP, True, 0.75)


@query
def interleaved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.emit(stream_windows_table(spark, sf_dir), E.AXIS, STEP, True, 0.75)
    return windows.interleaved_events(E.ordered(spark, sf_dir), w, E.AXIS)


@query
def window_features_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sliding_windows(E.normalised(spark, sf_dir), E.AXIS, SIZE, STEP, continuous=["z_value", "z_k"])
    return tidy(w.select(*E.SERIES, "start_index", *windows.feature_names(["z_value", "z_k"], [])))


@query
def window_features_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sliding_windows(E.ordered(spark, sf_dir), E.AXIS, SIZE, STEP, discrete=["state"])
    return w.select(*E.SERIES, "start_index", "state__mode", "state__n_changes")


@query
def window_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stream_windows_table(spark, sf_dir)
    return tidy(w.select(*E.SERIES, "start_index", "n_outlier", "n_range_violation", "valid_fraction", "contiguous"))


@query
def window_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sliding_windows(E.ordered(spark, sf_dir), E.AXIS, SIZE, STEP, label="y")
    return w.select(*E.SERIES, "start_index", *[windows.window_label(m).alias(m) for m in ("any_positive", "majority", "last")])


@query
def feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full feature matrix of the inference role in its channel-major column order."""
    d = E.normalised(spark, sf_dir).where(F.col("role") == "inference")
    w = windows.sliding_windows(d, E.AXIS, 50, 10, continuous=["z_value", "z_k"], discrete=["state"])
    return tidy(w.select("series_id", "start_index", *windows.feature_names(["z_value", "z_k"], ["state"])))


# ---- drift injection ------------------------------------------------------------------------


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference rows with frozen statistics and the length of their series."""
    return ordering.with_length(inference(spark, sf_dir), E.STREAM, "n_stream")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = inject.schedule("gradual", 3.0, F.col("row_idx"), F.col("n_stream"))
    d = inject.inject(streamed(spark, sf_dir), ["value", "k"], level, "offset", expansion=1.5)
    return inject.ground_truth(d, "gradual", "offset", ["value", "k"], 3.0, 42, by=["series_id"])


def schedule_query(name: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = streamed(spark, sf_dir)
        level = inject.schedule(name, 3.0, F.col("row_idx"), F.col("n_stream"), **options)
        return tidy(d.select("series_id", "row_idx", level.alias("schedule")))

    return run


QUERIES["schedule_sudden"] = schedule_query("sudden", start_fraction=0.4, end_fraction=0.9)
QUERIES["schedule_gradual"] = schedule_query("gradual", duration_fraction=0.2)
QUERIES["schedule_recurring"] = schedule_query("recurring", start_fraction=0.2, period_fraction=0.1, n_cycles=3)
QUERIES["schedule_stress"] = schedule_query("stress", start_fraction=0.3, steps=5)


@query
def drift_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = flow_profile(spark, sf_dir)
    parts = [
        inject.drift_channels(p, "top_variance", 2).withColumn("policy", F.lit("top_variance")),
        inject.drift_channels(p, "random", 2).withColumn("policy", F.lit("random")),
        inject.drift_channels(p, "all_continuous").withColumn("policy", F.lit("all_continuous")),
        inject.drift_channels(p, explicit=["l_tax", "l_quantity"]).withColumn("policy", F.lit("explicit")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def injected(spark: SparkSession, sf_dir: str, mechanism: str, **options) -> DataFrame:
    d = streamed(spark, sf_dir)
    level = inject.schedule("sudden", 1.5, F.col("row_idx"), F.col("n_stream"))
    return inject.inject(d, ["value", "k"], level, mechanism, expansion=1.5, key=["event_id"], **options)


def inject_query(mechanism: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = injected(spark, sf_dir, mechanism, **options)
        return tidy(d.select("event_id", "value__drifted", "k__drifted"))

    return run


for _m in inject.MECHANISMS:
    QUERIES[f"inject_{_m}"] = inject_query(_m)
QUERIES["inject_relative"] = inject_query("offset", units="relative")


@query
def inject_state_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flip chance follows a gradual schedule; the observed states are a handful of values."""
    d = streamed(spark, sf_dir).withColumn("schedule", inject.schedule("gradual", 3.0, F.col("row_idx"), F.col("n_stream")))
    states = profile.unpivot(d, ["state"]).groupBy("value").agg(F.count("*").alias("n")).agg(
        F.array_sort(F.collect_list(F.col("value").cast("int"))).alias("states")  # one entry per discrete state
    )
    flip = inject.state_flip("state", F.col("states"), F.col("schedule"), F.lit(3.0), 0.6, [F.col("event_id")])
    return d.crossJoin(F.broadcast(states)).select("event_id", "state", flip.alias("flipped"))


@query
def clip_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many drifted values were held back, and the range they reach."""
    d = injected(spark, sf_dir, "offset")
    raw = F.col("k") + F.col("schedule") * F.col("k__std")
    return tidy(
        d.groupBy("series_id").agg(
            F.count_if((F.col("schedule") > 0) & (F.abs(raw - F.col("k__drifted")) > 1e-9)).alias("n_clipped"),
            F.min("k__drifted").alias("lowest"), F.max("k__drifted").alias("highest"),
        )
    )


@query
def injection_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows each role offers to the injection, after its checks passed."""
    inject.check_injection("inference", ["baseline_train", "baseline_validation"], "offset", "baseline_sigma", start_fraction=0.5)
    d = E.telemetry(spark, sf_dir)
    return d.groupBy("role").agg(F.count("*").alias("n"), F.bool_and(F.col("role") == "inference").alias("may_drift"))


@query
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(truth(spark, sf_dir))


@query
def realised_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inject.realised_magnitude(injected(spark, sf_dir, "offset"), ["value", "k"], by=["series_id"]))


@query
def measured_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed from two separate tables: drifted minus clean, and between clean windows."""
    drifted = injected(spark, sf_dir, "offset").select("series_id", "row_idx", "schedule", "value__drifted")
    clean = E.ordered(spark, sf_dir).where(F.col("role") == "inference").select("series_id", "row_idx", "value")
    both = drifted.join(clean, ["series_id", "row_idx"])
    late = F.col("schedule") > 0
    return tidy(
        both.groupBy("series_id").agg(
            F.avg(F.when(late, F.col("value__drifted") - F.col("value"))).alias("raw_shift"),
            (F.avg(F.when(late, F.col("value__drifted"))) - F.avg(F.when(~late, F.col("value__drifted")))).alias("level_shift"),
        )
    )


@query
def measured_window_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of window means that start after the onset minus those that end before it."""
    d = injected(spark, sf_dir, "offset")
    w = windows.sliding_windows(d, E.STREAM, SIZE, STEP, continuous=["value__drifted"])
    onset = d.groupBy("series_id").agg(F.min(F.when(F.col("schedule") > 0, F.col("row_idx"))).alias("onset"))
    j = w.join(onset, "series_id")
    mean = F.col("value__drifted__mean")
    return tidy(
        j.groupBy("series_id").agg(
            (
                F.avg(F.when(F.col("start_index") >= F.col("onset"), mean))
                - F.avg(F.when(F.col("end_index") <= F.col("onset"), mean))
            ).alias("window_shift")
        )
    )


@query
def drift_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post minus pre mean of the drifted channel under the three normalisers."""
    d = injected(spark, sf_dir, "offset")
    moved = d.drop("value", "k").withColumnsRenamed({"value__drifted": "value", "k__drifted": "k"})
    d = E.materialise(moved, "absorption")
    run = quality.normalize_running(d, E.STREAM, E.CONTINUOUS)
    both = rolling(spark, sf_dir, run, list(E.CONTINUOUS), 50)
    z = {"frozen": quality.normalize_frozen("value"), "running": F.col("value__run"), "rolling": F.col("value__roll")}
    late = F.col("schedule") > 0
    shift = lambda c: F.avg(F.when(late, c)) - F.avg(F.when(~late, c))
    out = both.groupBy("series_id").agg(*[shift(c).alias(m) for m, c in z.items()])
    return tidy(
        out.select(
            "series_id", *z, (F.col("running") / F.col("frozen")).alias("running_retained"),
            (F.col("rolling") / F.col("frozen")).alias("rolling_retained"),
        )
    )


# ---- audits -----------------------------------------------------------------------------------


@query
def time_axis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.time_axis_report(flow_ordered(spark, sf_dir), FLOW, "l_shipdate", 86400.0))


@query
def time_axis_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.time_axis_report(E.ordered(spark, sf_dir), E.AXIS, "ts", 43200.0))


@query
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flow_ordered(spark, sf_dir)
    r = audit.time_axis_report(d, FLOW, "l_shipdate", 86400.0)
    return tidy(audit.load_report(r, 1000, ("1995-01-01 00:00:00", "2001-12-31 00:00:00"), F.lit(0), 86400.0))


#: Every table of the driver, and the time column of those that have one.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)
STAMPS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: tables.scan_parquet(spark, f"{sf_dir}/{n}.parquet") for n in TABLES}


@query
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every table."""
    return audit.dataset_audit(all_tables(spark, sf_dir))


@query
def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.table_facts(all_tables(spark, sf_dir), STAMPS))


@query
def interval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.interval_histogram(flow_ordered(spark, sf_dir), FLOW, "l_shipdate"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables, a re-ordered copy of the labels, and one in which some rows differ (written once)."""

    def build() -> DataFrame:
        t = all_tables(spark, sf_dir)
        t["labels_copy"] = t["labels"].repartition("toxic").select("toxic", "quality", "doc_id")
        flipped = F.when(F.col("doc_id") % 97 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
        t["labels_changed"] = t["labels"].withColumn("toxic", flipped)
        return materialise(audit.digest_tree(t), "digest-tree")

    return E.staged(spark, sf_dir, "digests", build)


@query
def duplicate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with the same columns and rows; the copy of the labels must be found."""
    return audit.duplicate_tables(digests(spark, sf_dir))


@query
def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tables with the same columns differ."""
    return audit.table_differences(digests(spark, sf_dir))


@query
def table_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: tables.scan_parquet(spark, f"{sf_dir}/{n}.parquet")
    return tidy(audit.table_chronology({"events": (read("events"), "ts"), "orders": (read("orders"), "o_orderdate"), "lineitem": (read("lineitem"), "l_shipdate")}))


@query
def align_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against labels by position: labels cover a part only, so this must fail."""
    read = lambda n: tables.scan_parquet(spark, f"{sf_dir}/{n}.parquet").select("doc_id").withColumn("stream", F.lit("docs"))
    number = lambda df: ordering.causal_order(df, ("stream",), ("doc_id",))
    return audit.align_labels(number(read("documents")), number(read("labels")), "row_idx", "doc_id")


@query
def stamp_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: tables.scan_parquet(spark, f"{sf_dir}/{n}.parquet").select("doc_id")
    return audit.stamp_set_diff(read("documents"), read("labels"), ["doc_id"])


@query
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared columns of two tables that differ in some, with their row counts on either side."""
    a = tables.scan_parquet(spark, f"{sf_dir}/documents.parquet")
    b = tables.scan_parquet(spark, f"{sf_dir}/labels.parquet")
    diff = audit.schema_diff(a, b)
    counts = a.agg(F.count("*").alias("n_left")).join(b.agg(F.count("*").alias("n_right")), F.lit(True))
    return counts.select(
        F.lit("|".join(diff["missing"])).alias("missing"), F.lit("|".join(diff["extra"])).alias("extra"),
        F.lit(diff["reordered"]).alias("reordered"), "n_left", "n_right",
    )


@query
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.scan_parquet(spark, f"{sf_dir}/documents.parquet").join(tables.scan_parquet(spark, f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return tidy(audit.class_distribution(d, "quality", ["lang"]))


@query
def positive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.positive_runs(E.ordered(spark, sf_dir), E.AXIS, "y")


@query
def ts_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n, c: audit.stamp_resolution(tables.scan_parquet(spark, f"{sf_dir}/{n}.parquet"), c).withColumn("table_name", F.lit(n))
    return read("events", "ts").unionByName(read("lineitem", "l_shipdate"))


@query
def assert_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.assert_causal(E.telemetry(spark, sf_dir), "ts"))


@query
def pool_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.telemetry(spark, sf_dir)
    part = lambda r: d.where(F.col("role") == r)
    pooled = audit.pool_baselines([part("baseline_train"), part("baseline_validation")], ["value", "k"])
    return tidy(pooled.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.stddev_pop("k").alias("std_k")))
