"""Audits of whole tables, quarantine of lines, the exactly-once log and the one-pass sample."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators import audit, feedback
from tidegauge.session import shared_dir
from tidegauge.sources import sinks, tables


def test_audit_counts_narrow_columns_and_names_wide_ones(spark):
    rows = [(i, i % 3 if i % 10 else None, f"t{i % 12}", float(i % 2) / 3, [0.5, None], None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, few int, text string, x double, v array<double>, none string")
    got = {r.column: r for r in audit.dataset_audit({"a": df, "b": df.limit(0)}).where("table_name = 'a'").collect()}
    assert got["id"].is_wide and got["id"].n_unique is None and got["id"].distribution is None
    assert (got["few"].n_unique, got["few"].n_missing, got["few"].distribution) == (3, 40, "0:120|1:120|2:120")
    assert got["text"].n_unique == 12 and not got["text"].is_wide
    assert got["x"].distribution == "0:200|333333:200" and got["v"].distribution == "500000,\\N:400" and got["v"].zero_variance
    assert (got["none"].n_missing, got["none"].n_unique, got["none"].zero_variance) == (400, 0, True)


def test_digests_name_equal_tables_and_narrow_differences(spark):
    r = random.Random(4)
    rows = [(i, r.random(), r.choice(["x", None, "y\x1fz"])) for i in range(3000)]
    a = spark.createDataFrame(rows, "id long, v double, s string")
    changed = [(i, v + (i == 77), s) for i, v, s in rows]
    tree = audit.digest_tree({
        "a": a, "copy": a.orderBy(F.desc("id")).repartition(3).select("s", "id", "v"), "changed": spark.createDataFrame(changed, a.schema),
        "twice": a.unionByName(a.where("id = 5")), "other": a.withColumnRenamed("v", "w"), "empty": a.limit(0),
    })
    got = {x.table_name: x for x in audit.duplicate_tables(tree).collect()}
    assert got["a"].equal_tables == got["copy"].equal_tables == "a|copy" and got["a"].n_equal == 2
    assert all(got[n].n_equal == 1 for n in ("changed", "twice", "other"))
    apart = {(x.left_table, x.right_table): x for x in audit.table_differences(tree).collect()}
    assert ("a", "copy") not in apart and not any("other" in k for k in apart)
    assert apart["a", "changed"].n_buckets in (1, 2)  # the row as it was, and as it is
    assert apart["a", "twice"].n_buckets == 1 and apart["a", "twice"].right_rows == apart["a", "twice"].left_rows + 1
    root = tree.where("node = '' and table_name = 'a'").first()
    leaves = tree.where("length(node) = 2 and table_name = 'a'").agg(F.sum("hi"), F.sum("n_rows")).first()
    assert (root.hi, root.n_rows) == (leaves[0], leaves[1])


def test_file_facts_come_from_the_reader(spark):
    path = f"{shared_dir(spark)}/facts"
    spark.range(100).repartition(3).write.parquet(path)
    row = audit.file_facts({"t": tables.scan_parquet(spark, path)}).first()
    assert row.n_files == 3 and row.n_bytes > 0


def test_lines_that_do_not_fit_are_quarantined(spark):
    path = f"{shared_dir(spark)}/lines"
    lines = ["at,id,x", "2024-01-01,1,2.5", "2024-01-01,2", "2024-01-01,3,2.5,9", "2024-01-01,four,2.5", "2024-01-01,5,much", '"a,b",6,1.0', "2024-01-01,,"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    schema = T.StructType().add("at", "string").add("id", "long").add("x", "double")
    good, bad = tables.scan_quarantined(spark, path, schema)
    assert sorted((r.at, r.id, r.x) for r in good.collect() if r.id) == [("2024-01-01", 1, 2.5), ("a,b", 6, 1.0)] and good.count() == 3
    assert {r.line: r.reason for r in bad.collect()} == {
        "2024-01-01,2": "too few fields", "2024-01-01,3,2.5,9": "too many fields", "2024-01-01,four,2.5": "not a bigint: id", "2024-01-01,5,much": "not a double: x",
    }


def test_a_log_batch_counts_once(spark):
    path = f"{shared_dir(spark)}/once"
    log = lambda n: spark.createDataFrame([("start", "c", "f", k, None) for k in range(n)], "event string, config_name string, config_fingerprint string, master_seed int, detail string")
    for _ in range(2):
        sinks._append_batch(log(4), 0, "run", path, None)
    # Rows without a manifest line don't count: the job was lost between the two.
    sinks.rendered(log(9), "run").write.option("header", True).csv(f"{path}/rows/batch=1")
    assert sinks.read_log_stream(spark, "run", path).count() == 4
    sinks._append_batch(log(3), 1, "run", path, None)
    sinks.replay_last(spark, "run", path)
    assert sinks.read_log_stream(spark, "run", path).count() == 7
    assert sorted((r.batch, r.n_rows) for r in sinks.read_manifest(spark, path).collect()) == [(0, 4), (1, 3)]
    with pytest.raises(ValueError):
        sinks._append_batch(log(1).withColumn("more", F.lit(1)), 2, "run", path, None)


def test_sample_takes_the_smallest_of_each_class_in_one_scan(spark):
    r = random.Random(9)
    rows = [(i, r.choices([0, 1, 2, 3], [90, 5, 4, 1])[0], r.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, y int, h double").repartition(7)
    got = feedback.stratified_sample(df, "y", {0: 50, 1: 20, 2: 500}, F.col("h"))
    assert got.columns == ["id", "y", "h"]
    want = {x[0] for c, n in ((0, 50), (1, 20), (2, 500)) for x in sorted((x for x in rows if x[1] == c), key=lambda x: x[2])[:n]}
    assert {x.id for x in got.collect()} == want
    assert feedback.stratified_sample(df.limit(0), "y", {0: 5}, F.col("h")).collect() == []


def test_retraining_refuses_too_few_or_too_many_labels(spark):
    rows = lambda a, b: spark.createDataFrame([("baseline",)] * a + [("feedback",)] * b, "origin string")
    row = feedback.retraining(rows(10, 30), ["x"], "v2", "v1", 7).first()
    assert (row.total_samples_trained, row.baseline_samples_used, row.feedback_samples_used, row.status) == (40, 10, 30, "TRAINED")
    got = [feedback.retraining(rows(a, b), ["x"], "v2", "v1", 7).first() for a, b in ((10, 24), (0, 1001))]
    assert [(r.status, r.reason) for r in got] == [("REFUSED", "too few labels"), ("REFUSED", "more labels than the buffer holds")]
    with pytest.raises(ValueError):
        feedback.retraining(rows(10, 30), ["event_id"], "v2", "v1", 7)
