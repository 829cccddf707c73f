"""What is written in between goes when it has been read, and runs are replayed some devices at a time."""

import datetime
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import detect, ordering, routing
from tidegauge.operators.ordering import Axis
from tidegauge.plans import evaluation, events, runs
from tidegauge.session import lasting, materialise, passing, shared_dir
from tidegauge.sources import sinks

AXIS = Axis(("series",))


def written(spark):
    """How many tables of each tag there are."""
    top = shared_dir(spark).removeprefix("file://")
    return Counter(name[:-33] for name in (os.listdir(top) if os.path.isdir(top) else []) if os.path.isdir(f"{top}/{name}"))


@pytest.fixture
def added(spark):
    before = written(spark)
    return lambda: {k: n for k, n in (written(spark) - before).items()}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, begin = random.Random(7), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        at = begin + datetime.timedelta(days=30 * r.random())
        rows.append((i, at, r.choice([0, 1, 1, 2, 5]), r.choice(["click", "view", "purchase", "error"]), r.gauss(50, 20), '{"k": %d}' % r.randrange(100)))
    out = str(tmp_path_factory.mktemp("events"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{out}/events.parquet")
    return out


def test_tables_go_with_their_scope_but_those_that_are_kept(spark, added):
    table = lambda tag: materialise(spark.range(3), tag)
    with passing(spark, "whole"):
        with passing(spark, "whole", "half"):
            part, half, whole = table("part"), table("half"), table("whole")
            assert added() == {"part": 1, "half": 1, "whole": 1}
        assert added() == {"half": 1, "whole": 1} and half.count() == 3
        with lasting():
            apart = table("apart")
    assert added() == {"whole": 1, "apart": 1} and whole.count() == apart.count() == 3
    with pytest.raises(ValueError), passing(spark):
        table("lost")
        raise ValueError
    assert added() == {"whole": 1, "apart": 1}


def shuffle_files(spark):
    top = spark._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf())
    return {f for t in top for _, _, names in os.walk(t) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_what_was_shuffled_goes_when_the_table_is_written(spark, tmp_path):
    dealt = spark.range(10_000).repartition(4, "id")

    def left(write):
        before = shuffle_files(spark)
        write()
        for _ in range(50):  # they go in the background
            if not (new := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        return new

    with lasting():
        assert not left(lambda: materialise(dealt, "dealt"))
    assert not left(lambda: sinks.write_tables({"one": dealt}, str(tmp_path / "tables")))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_ranges_of_series_hold_each_row_once(spark):
    sizes = {None: 3, -4: 2, 0: 50, 3: 1, 9: 7, 10: 30}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "series long")
    for rows, most in ((1, 6), (10, 4), (40, 3), (1000, 1)):
        parts = [Counter(r.series for r in df.where(c).collect()) for c in ordering.series_waves(df, "series", rows)]
        assert sum(parts, Counter()) == Counter(sizes)
        assert all(p[k] in (0, n) for p in parts for k, n in sizes.items())
        assert len([p for p in parts if p]) == len(parts) <= most
        assert all(sum(p.values()) - max(p.values()) < rows for p in parts)
    assert df.where("series > 100").where(ordering.series_waves(df.where("series > 100"), "series")[0]).count() == 0


def test_a_fold_leaves_what_its_rows_are_read_from(spark, added):
    r = random.Random(3)
    rows = [(s, i, r.random() + (i > 300)) for s in ("a", "b") for i in range(600)]
    df = spark.createDataFrame(rows, "series string, row_idx long, x double")
    want = sorted(map(tuple, detect.adwin(df, AXIS, "x").collect()))
    with lasting():
        got = detect.adwin(df, AXIS, "x", segment_rows=64)
    assert set(added()) == {"run", "ends"}
    assert sorted(map(tuple, got.collect())) == want


def test_runs_are_the_same_range_by_range_and_nothing_else_stays(spark, sf_dir, added, monkeypatch):
    events.forget()
    names = ("experiment_grid", "routing_metrics", "pre_post_metrics", "latency_by_run", "row_trace", "adwin", "drift_metrics_runs")
    queries = {n: getattr(evaluation, n) for n in names}
    want = {n: sorted(map(str, q(spark, sf_dir).collect())) for n, q in queries.items()}
    cut = lambda df, column, rows=0: ordering.series_waves(df, column, 1)
    monkeypatch.setattr(runs, "series_waves", cut)
    monkeypatch.setattr(evaluation, "series_waves", cut)
    loop = routing.closed_loop
    monkeypatch.setattr(runs, "closed_loop", lambda *a, **b: loop(*a, **b, segment_rows=64, warm=40))
    events.forget()
    before = added()
    replayed = runs.replayed(spark, sf_dir)
    assert {k for k, n in added().items() if n > before.get(k, 0)} <= {"ordered", "offsets", "moments", "signal-mean", "runs"}
    assert added()["runs"] - before["runs"] == 4 == replayed.select("series_id").distinct().count()
    assert {n: sorted(map(str, q(spark, sf_dir).collect())) for n, q in queries.items()} == want
    assert added()["detected"] - before["detected"] == 4 and not {"alarms", "drifted", "placed", "retrained", "segments", "run", "ends"} & set(added())
    events.forget()


def test_values_that_methods_share_take_no_room_of_their_own(spark, sf_dir):
    events.forget()
    replayed = runs.replayed(spark, sf_dir)
    assert replayed.columns == list(runs.KEPT)
    for f in replayed.inputFiles():
        rows = spark.read.parquet(f).withColumn("at", F.monotonically_increasing_id()).orderBy("at").select("seed", "series_id", "row_idx", "method").collect()
        assert rows == sorted(rows)
    events.forget()
