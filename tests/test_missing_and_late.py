"""Missing values, repeated labels and wrong bounds are refused or handled, never counted silently."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import detect, feedback, windows
from tidegauge.operators.ordering import Axis
from tidegauge.plans import adapt
from tidegauge.plans import events as E

AXIS = Axis(("series",))


def rows(spark, values):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series string, row_idx long, x double")


def test_smoothing_refuses_a_missing_value(spark):
    assert AXIS.ema(rows(spark, [10.0, 10.0, 10.0]), "s", F.col("x"), 0.8).count() == 3
    with pytest.raises(Exception, match="a value is missing"):
        AXIS.ema(rows(spark, [10.0, None, 10.0]), "s", F.col("x"), 0.8).collect()


def test_a_hole_poisons_window_statistics(spark):
    got = windows.sliding_windows(rows(spark, [10.0, 10.0, None, 10.0, 10.0, 10.0]), AXIS, 3, 3, continuous=["x"])
    by_start = {r["start_index"]: r for r in got.collect()}
    assert by_start[0]["x__mean"] is None and by_start[0]["x__std"] is None and by_start[0]["x__slope"] is None
    assert by_start[3]["x__mean"] == 10.0 and by_start[3]["x__std"] == 0.0


def test_the_last_label_of_an_observation_counts_once(spark):
    predictions = spark.createDataFrame([("a", 0, 1), ("a", 1, 0)], "series string, row_idx long, p int")
    arrivals = spark.createDataFrame([("a", 0, 0, 5), ("a", 0, 1, 9)], "series string, row_idx long, label int, arrival_index long")
    got = sorted(map(tuple, feedback.delayed_feedback(predictions, arrivals, AXIS).select("row_idx", "label", "arrival_index", "is_labeled").collect()))
    assert got == [(0, 1, 9, True), (1, None, None, False)]


def test_too_small_a_last_index_is_refused(spark):
    df = spark.range(200).select(F.lit("a").alias("series"), F.col("id").alias("row_idx"), F.lit(1.0).alias("x"))
    with pytest.raises(ValueError, match="last_index=70"):
        detect.adwin(df, AXIS, "x", segment_rows=64, last_index=70)


def test_candidates_are_judged_on_every_validation_row(spark):
    sf_dir = "/root/testdata/sf0.001"
    cycles = adapt.cycles(spark, sf_dir)
    assert cycles.count() and not hasattr(adapt, "VALIDATION_ROWS")
    val = E.normalised(spark, sf_dir).where(F.col("role") == "baseline_validation")
    assert val.select("series_id").distinct().count() >= cycles.select("series_id").distinct().count()
