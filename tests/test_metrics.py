from pyspark.sql import functions as F

from tidegauge.functions import student
from tidegauge.operators import metrics
from tidegauge.operators.ordering import Axis


def labelled(spark, truth, pred):
    rows = [(i, t, p) for i, (t, p) in enumerate(zip(truth, pred))]
    return spark.createDataFrame(rows, "row_idx long, label int, prediction int")


def test_perfect_imperfect_empty(spark):
    r = metrics.classification_metrics(labelled(spark, [0, 0, 1, 1], [0, 0, 1, 1])).first()
    assert (r.accuracy, r.f1, r.mcc, r.tp, r.fp, r.fn, r.tn) == (1.0, 1.0, 1.0, 2, 0, 0, 2)
    r = metrics.classification_metrics(labelled(spark, [0, 0, 1, 1], [0, 1, 0, 1])).first()
    assert (r.accuracy, r.mcc, r.sample_count) == (0.5, 0.0, 4)
    r = metrics.classification_metrics(labelled(spark, [], [])).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.mcc, r.sample_count) == (0.0, 0.0, 0.0, 0.0, 0.0, 0)


def test_macro_over_present_classes_only(spark):
    r = metrics.classification_metrics(labelled(spark, [0, 0, 0], [0, 0, 0])).first()
    assert (r.precision, r.recall, r.f1, r.mcc) == (1.0, 1.0, 1.0, 0.0)
    r = metrics.classification_metrics(labelled(spark, [0, 0, 0, 1], [0, 0, 0, 0])).first()
    assert abs(r.f1 - (6 / 7) / 2) < 1e-12 and r.mcc == 0.0


def test_pre_post(spark):
    d = labelled(spark, [0, 1, 0, 1, 0, 1], [0, 1, 0, 0, 0, 0])
    r = metrics.pre_post_metrics(d, "label", "prediction", "row_idx", F.lit(3)).first()
    assert (r.pre_samples, r.post_samples, r.pre_accuracy) == (3, 3, 1.0)
    assert abs(r.delta_accuracy - (1 / 3 - 1)) < 1e-12 and abs(r.pct_change_accuracy + 200 / 3) < 1e-9


def test_detection_delay(spark):
    d = spark.range(1000).select(
        F.col("id").alias("row_idx"), F.col("id").isin(450, 520, 560).alias("alarm"), F.lit(False).alias("per"), (F.col("id") / 1000.0).alias("sev")
    )
    r = metrics.drift_metrics(d, "row_idx", "alarm", "per", "sev", F.lit(500)).first()
    assert (r.first_detection_point, r.detection_delay, r.false_alarms_pre_drift, r.post_drift_alarms) == (520, 20, 1, 2)
    assert r.detection_status == "DETECTED" and r.transient_alarms == 3
    r = metrics.drift_metrics(d.where("row_idx < 300"), "row_idx", "alarm", "per", "sev", F.lit(500)).first()
    assert (r.detection_status, r.detection_delay, r.post_drift_mean_severity) == ("NOT DETECTED", None, 0.0)


def test_routing_shares(spark):
    acts = ["EDGE", "EDGE", "HYBRID", "CLOUD", "CLOUD"]
    d = spark.createDataFrame([("a", i, a, a == "HYBRID") for i, a in enumerate(acts)], "series string, row_idx long, action string, fell boolean")
    r = metrics.routing_metrics(d, Axis(("series",), chunk_rows=2), "action", "fell").first()
    assert (r.edge_percentage, r.hybrid_percentage, r.cloud_percentage, r.offloading_ratio) == (40.0, 20.0, 40.0, 40.0)
    assert (r.switch_count, r.hybrid_fallback_rate, r.hybrid_status) == (2, 100.0, "OBSERVED")


def test_latencies(spark):
    d = spark.createDataFrame([(0.010,), (0.020,), (0.030,), (None,), (float("nan"),)], "s double")
    r = metrics.latency_summary(d, "s").first()
    assert (r["count"], round(r.mean_ms, 9), round(r.median_ms, 9), round(r.max_ms, 9)) == (3, 20.0, 20.0, 30.0)
    empty = metrics.latency_summary(d.where("s > 1 and not isnan(s)"), "s").first()
    assert (empty["count"], empty.mean_ms, empty.p95_ms) == (0, 0.0, 0.0)
    assert metrics.latency_summary(d.where("s > 1 and not isnan(s)"), "s", empty_as_null=True).first().mean_ms is None


def test_student_values():
    # Published table values.
    for p, df, want in ((0.975, 4, 2.776445), (0.975, 1, 12.706205), (0.95, 10, 1.812461), (0.995, 30, 2.749996)):
        assert abs(student.quantile(p, df) - want) < 1e-5
    assert abs(student.two_sided_p(2.776445, 4) - 0.05) < 1e-6


def test_intervals_and_paired_tests(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("one", 5.0), ("flat", 2.0), ("flat", 2.0)]
    got = {r.g: r for r in metrics.confidence_interval(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    half = 4.302653 / 3**0.5
    assert abs(got["a"].ci_upper - (2 + half)) < 1e-5 and abs(got["a"].ci_lower - (2 - half)) < 1e-5
    assert (got["one"].std, got["one"].ci_lower, got["flat"].ci_upper) == (0.0, 5.0, 2.0)
    pairs = [("t", 1.0, 0.5), ("t", 2.0, 1.0), ("t", 3.0, 2.9), ("same", 1.0, 0.5), ("same", 2.0, 1.5), ("few", 1.0, 0.0)]
    d = spark.createDataFrame(pairs, "c string, first_value double, second_value double").withColumn("difference", F.col("first_value") - F.col("second_value"))
    got = {r.c: r for r in metrics.paired_test(d, ["c"]).collect()}
    assert got["same"].test_name == "Exact zero-variance paired difference" and got["same"].p_value == 1.0
    assert got["few"].test_name == "NOT STATISTICALLY TESTABLE" and got["few"].statistic is None
    mean, sd = 1.6 / 3, (sum((x - 1.6 / 3) ** 2 for x in (0.5, 1.0, 0.1)) / 2) ** 0.5
    assert abs(got["t"].statistic - mean / (sd / 3**0.5)) < 1e-9
    assert abs(got["t"].p_value - student.two_sided_p(got["t"].statistic, 2)) < 1e-12


def test_delivery_without_transmissions_is_null(spark):
    d = spark.createDataFrame([(None, True, False)], "network_latency_s double, success boolean, packet_lost boolean")
    r = metrics.delivery_metrics(d).first()
    assert (r.total_transmissions, r.failure_rate, r.mean_ms) == (0, None, None)


def test_consistency_flags_a_bad_run(spark):
    cols = "method string, seed int, f1 double, edge_percentage double, cloud_percentage double, hybrid_percentage double"
    d = spark.createDataFrame([("a", 1, 0.5, 50.0, 50.0, 0.0), ("a", 2, 1.5, 50.0, 40.0, 0.0), ("a", 2, float("nan"), 100.0, 0.0, 0.0)], cols)
    r = metrics.run_consistency(d, ["f1"], ["f1"]).first()
    assert (r.n_runs, r.n_method_seed, r.n_out_of_bounds, r.n_not_finite, r.n_bad_share_sum) == (3, 2, 2, 1, 1)
