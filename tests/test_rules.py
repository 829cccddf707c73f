"""Injection, feedback, models, checks, sinks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import checks, draws, signals
from tidegauge.operators import audit, feedback, inject, models
from tidegauge.operators.ordering import Axis
from tidegauge.session import shared_dir
from tidegauge.sources import sinks, tables

AXIS = Axis(("series",), chunk_rows=16)


def level(spark, n, name, **kw):
    d = spark.range(n).select(inject.schedule(name, 2.0, F.col("id"), F.lit(n), **kw).alias("m"), "id")
    return [r.m for r in d.orderBy("id").collect()]


def test_schedules(spark):
    assert level(spark, 10, "none") == [0.0] * 10
    assert level(spark, 10, "sudden", start_fraction=0.5, end_fraction=0.8) == [0.0] * 5 + [2.0] * 3 + [0.0] * 2
    got = level(spark, 10, "gradual", start_fraction=0.4, duration_fraction=0.4)
    assert got == [0.0] * 4 + [0.5, 1.0, 1.5, 2.0] + [2.0] * 2
    got = level(spark, 20, "recurring", start_fraction=0.1, period_fraction=0.15, n_cycles=2)
    assert got == [0.0] * 2 + [2.0] * 3 + [0.0] * 3 + [2.0] * 3 + [0.0] * 9
    assert level(spark, 10, "stress", start_fraction=0.0, steps=4) == [0.5] * 2 + [1.0] * 3 + [1.5] * 3 + [2.0] * 2
    with pytest.raises(ValueError):
        level(spark, 10, "sideways")


def test_draws_look_uniform_and_normal_and_follow_the_key(spark):
    d = spark.range(20000).select(draws.uniform(1, "a", F.col("id")).alias("u"), draws.normal(1, "a", F.col("id")).alias("g"), draws.uniform(2, "a", F.col("id")).alias("v"))
    r = d.agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.avg("g").alias("gm"), F.stddev_pop("g").alias("gs"), F.corr("u", "v").alias("c")).first()
    assert abs(r.m - 0.5) < 0.01 and 0 <= r.lo < 0.001 and 0.999 < r.hi < 1
    assert abs(r.gm) < 0.03 and abs(r.gs - 1) < 0.03 and abs(r.c) < 0.03
    one = spark.range(50).repartition(7).select("id", draws.uniform(1, "a", F.col("id")).alias("u"))
    two = spark.range(50).coalesce(1).select("id", draws.uniform(1, "a", F.col("id")).alias("u"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_clip_never_pulls_a_recorded_value_in(spark):
    d = spark.createDataFrame([(5.0, 1.0), (99.0, 1.0), (5.0, 0.0), (None, 1.0)], "x double, m double").crossJoin(
        spark.createDataFrame([(0.0, 10.0)], "x__minimum double, x__maximum double")
    )
    got = [r.v for r in d.select(inject.clip_physical("x", F.col("x") + 50, F.col("m") > 0).alias("v")).collect()]
    assert got == [10.0, 99.0, 5.0, None]


def test_injection_refuses_what_would_spoil_the_experiment():
    ok = ("inference", ["baseline_train"], "offset", "baseline_sigma")
    inject.check_injection(*ok, start_fraction=0.5)
    for bad in (("baseline_train", *ok[1:]), (*ok[:2], "shuffle", ok[3]), (*ok[:3], "percent")):
        with pytest.raises(ValueError):
            inject.check_injection(*bad)
    with pytest.raises(ValueError):
        inject.check_injection(*ok, modify_labels=True)
    with pytest.raises(ValueError):
        inject.check_injection(*ok, start_fraction=0.2, baseline_fraction=0.3)


def test_reliability_bounds_and_weakest_link(spark):
    r = lambda *v: signals.harmonic_reliability(*[F.lit(float(x)) for x in v])
    d = spark.range(1).select(r(1, 0, 0, 1).alias("best"), r(1, 1, 0, 1).alias("wrong"), r(0.5, 0.2, 0.2, 1).alias("mid"), r(0.5, 0.2, 0.6, 1).alias("worse")).first()
    assert abs(d.best - 1.0) < 1e-6 and d.wrong < 1e-6 and d.worse < d.mid
    assert abs(d.mid - 4 / (1 / 0.5 + 2 / 0.8 + 1)) < 1e-6
    assert spark.range(1).select(signals.confidence(F.lit(0.5), F.lit(0.5)).alias("c")).first().c == 0.0


def test_leakage_and_log_schemas_are_refused(spark):
    with pytest.raises(ValueError):
        checks.leakage_guard(["Mean", "Target"])
    with pytest.raises(ValueError):
        checks.validate_observation(["ground_truth"])
    with pytest.raises(ValueError):
        models.causal_fit_data(spark.range(1), ["SrcAddr"], "y")
    d = spark.createDataFrame([("run", "c", "f", 1, ["x", None, "y"], True)], "event string, config_name string, config_fingerprint string, master_seed int, detail array<string>, extra boolean")
    with pytest.raises(ValueError):
        sinks.rendered(d, "run")
    with pytest.raises(ValueError):
        sinks.rendered(d.drop("extra", "detail"), "run")
    assert tuple(sinks.rendered(d.drop("extra"), "run").first()) == ("run", "c", "f", "1", "x||y")
    assert sinks.rendered(d.select("extra"), "flags", ["extra"]).first().extra == "1"


def test_sinks_round_trip(spark):
    root = f"{shared_dir(spark)}/sinks"
    d = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.25)], "method string, seed int, f1 double")
    sinks.write_tables({"scores": d}, root, ["method", "seed"])
    assert sorted(map(tuple, spark.read.parquet(f"{root}/scores").select("method", "seed", "f1").collect())) == [("m", 1, 0.5), ("m", 2, 0.25)]
    with pytest.raises(ValueError):
        sinks.write_sidecar(d, f"{root}/truth", ["f1", "nothing"])


def test_strict_time_stamps(spark):
    d = spark.createDataFrame([("2024-01-01 00:00:00",), (" 2024-01-02 10:00:00 ",), ("yesterday",)], "raw string")
    parsed = tables.parse_ts_strict(d, "raw")
    assert tuple(tables.unparsed(parsed, "raw").first()) == (3, 1, "yesterday")
    with pytest.raises(ValueError, match="yesterday"):
        tables.require_parsed(parsed, "raw")
    with pytest.raises(ValueError):
        tables.check_roles({"a": "baseline_train", "b": "test"})
    with pytest.raises(ValueError):
        tables.check_roles({"a": "baseline_train"})


def test_alignment_passes_on_a_good_pair_and_names_the_first_mismatch(spark):
    good = spark.range(10).select(F.col("id").alias("row_idx"), (F.col("id") * 60).alias("stamp"))
    r = audit.align_labels(good, good, "row_idx", "stamp").first()
    assert r.counts_equal and r.stamps_unique and r.elementwise_equal and r.sets_equal
    bad = good.withColumn("stamp", F.when(F.col("row_idx") >= 7, F.lit(0)).otherwise(F.col("stamp")))
    r = audit.align_labels(good, bad, "row_idx", "stamp").first()
    assert r.counts_equal and not r.stamps_unique and not r.sets_equal and (r.n_mismatched, r.first_mismatch) == (3, 7)


def test_schema_diff(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int"), spark.createDataFrame([(1, 2, 3)], "y int, x int, w int")
    assert audit.schema_diff(a, b) == {"missing": ["z"], "extra": ["w"], "reordered": True}


def test_duplicates_ignore_row_order(spark):
    a = spark.range(100).withColumn("v", F.col("id") % 7)
    tree = audit.digest_tree({"a": a, "copy": a.orderBy(F.desc("id")), "other": a.where("id < 99").unionByName(a.where("id = 0"))})
    got = {r.table_name: r.equal_tables for r in audit.duplicate_tables(tree).collect()}
    assert got == {"a": "a|copy", "copy": "a|copy", "other": "other"}


def feedback_case(spark, n=60):
    rows = spark.range(n).select(F.lit("a").alias("series"), F.col("id").alias("row_idx"), (F.col("id") % 2).cast("int").alias("prediction"))
    labels = rows.where("row_idx % 3 <> 0").select("series", "row_idx", F.lit(1).alias("label"), (F.col("row_idx") + F.col("row_idx") % 10).alias("arrival_index"))
    return rows, feedback.delayed_feedback(rows, labels, AXIS)


def buffer_loop(t, size, labelled):
    """Observations in the buffer at t whose label had arrived while they were in it."""
    return [i for i in range(max(0, t - size + 1), t + 1) if i in labelled and labelled[i] <= t and labelled[i] < i + size]


def test_eligibility_equals_the_queue(spark):
    rows, d = feedback_case(spark)
    labelled = {i: i + i % 10 for i in range(60) if i % 3}
    for size in (6, 20, 100):
        got = {r.row_idx: r.n_eligible for r in feedback.eligible_count_asof(rows, d, AXIS, size).collect()}
        assert got == {t: len(buffer_loop(t, size, labelled)) for t in range(60)}
    picked = feedback.eligible_feedback(d, AXIS, F.lit(45), 5, 30).collect()
    assert sorted(r.row_idx for r in picked) == buffer_loop(45, 30, labelled)[-5:]


def test_acausal_labels_are_refused(spark):
    rows = spark.createDataFrame([("a", 5)], "series string, row_idx long")
    early = spark.createDataFrame([("a", 5, 1, 4)], "series string, row_idx long, label int, arrival_index long")
    d = feedback.delayed_feedback(rows, early, AXIS)
    assert not d.first().causal and feedback.eligible_feedback(d, AXIS, F.lit(10)).count() == 0


def test_triggers_keep_the_cooldown(spark):
    rnd = random.Random(12)
    rows = [("a", i, rnd.random() < 0.5, rnd.random(), rnd.randrange(20, 40)) for i in range(300)]
    d = spark.createDataFrame(rows, "series string, row_idx long, is_persistent boolean, smoothed_severity double, n_eligible long")
    got = {r.row_idx: (r.fired, r.state) for r in feedback.adaptation_triggers(d, AXIS, cooldown=17).collect()}
    last = None
    for _, i, persistent, severity, n in rows:
        cooling = last is not None and i - last < 17
        fire = not cooling and persistent and severity >= 0.30 and n >= 25
        last = i if fire else last
        assert got[i] == (fire, "ELIGIBLE" if fire else "COOLDOWN" if cooling else "IDLE")


def test_gate(spark):
    truth = [0, 1] * 10
    rows = [(c, "baseline_validation", t, t if c != "bad" else 0, t if (c == "close" or i % 4) else 1 - t) for c in ("good", "bad", "close") for i, t in enumerate(truth)]
    rows += [("good", "inference", 1, 0, 1)] * 50
    d = spark.createDataFrame(rows, "c string, role string, label int, candidate_pred int, active_pred int")
    got = {r.c: (r.status, r.reason, r.validation_samples) for r in feedback.candidate_gate(d, by=["c"], role="role").collect()}
    assert got == {"good": ("ACCEPTED", "accepted", 20), "bad": ("REJECTED", "below_minimum", 20), "close": ("ACCEPTED", "accepted", 20)}
    worse = d.where("c = 'close' and role <> 'inference'").withColumn("candidate_pred", F.when(F.rand(1) < 2, F.col("label"))).limit(20)
    swap = worse.select("c", "role", "label", F.when((F.col("label") == 1), F.lit(1)).otherwise(F.lit(0)).alias("active_pred"), F.lit(None).cast("int").alias("candidate_pred"))
    assert feedback.candidate_gate(swap, by=["c"]).first().status == "REJECTED"


def test_versions_move_only_on_acceptance(spark):
    d = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([False, True, False, True])], "series string, n long, ok boolean")
    axis = Axis(("series",), "n", 2)
    audit_table = feedback.version_audit(d, axis, F.col("ok"))
    got = [(r.version, r.parent_version, r.status, r.active_version) for r in audit_table.orderBy("n").collect()]
    assert got == [("v2", "v1", "REJECTED", "v1"), ("v2", "v1", "ACTIVE", "v2"), ("v3", "v2", "REJECTED", "v2"), ("v3", "v2", "ACTIVE", "v3")]
    assert tuple(feedback.active_versions(audit_table, axis).first()) == ("a", "v3", 4, 2)


def test_naive_bayes_merges_and_separates(spark):
    rnd = random.Random(3)
    rows = [(rnd.gauss(3.0 * y, 1.0), rnd.gauss(-2.0 * y, 1.0), y) for y in (0, 1) for _ in range(200)]
    d = spark.createDataFrame(rows, "a double, b double, label int").repartition(4)
    whole = models.nb_fit(d, ["a", "b"])
    parts = models.nb_merge([models.nb_fit(d.where("a < 1"), ["a", "b"]), models.nb_fit(d.where("a >= 1"), ["a", "b"])])
    for w, p in zip(whole.orderBy("label").collect(), parts.orderBy("label").collect()):
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(w, p))
    scored = models.predict(d, models.nb_scorer(parts, ["a", "b"]))
    assert scored.where("prediction = label").count() > 380
    assert scored.where("abs(p0 + p1 - 1) > 1e-9").count() == 0


def test_boosted_trees_learn_a_rule(spark):
    rnd = random.Random(5)
    rows = [(x, y, int(x * y > 0)) for x, y in ((rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for _ in range(400))]
    d = spark.createDataFrame(rows, "a double, b double, label int")
    model = models.gbt_fit(d, ["a", "b"], trees=10, depth=4)
    assert models.predict(d, models.gbt_scorer(model, ["a", "b"])).where("prediction = label").count() > 360


def test_inputs_by_role_and_their_checks(spark):
    root = f"{shared_dir(spark)}/roles"
    files = {}
    for key, role, n in (("a", "baseline_train", 3), ("b", "baseline_validation", 2), ("c", "inference", 4)):
        spark.range(n).withColumn("name", F.lit(key)).write.parquet(f"{root}/{key}")
        files[key] = (f"{root}/{key}", role)
    d = tables.scan_by_role(spark, files)
    assert {r["role"]: (r.n_rows, r.known) for r in tables.role_counts(d).collect()} == {
        "baseline_train": (3, True), "baseline_validation": (2, True), "inference": (4, True)
    }
    assert audit.non_numeric_columns(d) == ["name", "role"]
    assert tables.feature_columns(d, ["role"], ["name"]) == ["id"]
    with pytest.raises(ValueError):
        tables.feature_columns(d, ["role"], include=["id", "absent"])


def test_nan_counts_as_missing(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert audit.missing_census(d, ["x"]).first().n_missing == 2
    assert [r.x for r in d.select(signals.nan_to_null(F.col("x")).alias("x")).collect()] == [1.0, None, None]
    assert [r.x for r in d.select(signals.winsorized_l1([signals.nan_to_null(F.col("x"))]).alias("x")).collect()] == [1.0, None, None]


class FakeSession:
    """Just enough of a session to ask where its shared folder is."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.applicationId = master, "fake"

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return None


def test_a_cluster_needs_a_shared_folder():
    assert shared_dir(FakeSession("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession(None, "spark://host:7077"))
    assert shared_dir(FakeSession(None, "local[2]"))
