import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ordering
from tidegauge.operators.ordering import Axis


def skewed(spark, n=600):
    """One series with most rows, many equal stamps, shuffled input."""
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        series = "hot" if rnd.random() < 0.7 else f"s{rnd.randrange(5)}"
        rows.append((series, rnd.randrange(4), i, rnd.uniform(-5, 5) if rnd.random() < 0.8 else None))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "series string, ts int, id int, x double").repartition(5)


def by_series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module")
def numbered(spark):
    rows, df = skewed(spark)
    return by_series(rows), ordering.causal_order(df, ("series",), ("ts", "id"))


def collected(df, name):
    return {(r["series"], r["row_idx"]): r[name] for r in df.collect()}


def test_causal_order_numbers_a_hot_series_across_partitions(numbered):
    want, df = numbered
    got = collected(df, "id")
    assert got == {(s, i): r[2] for s, rows in want.items() for i, r in enumerate(rows)}


def test_many_series_are_numbered_without_a_broadcast(spark):
    rows, df = skewed(spark)
    out = ordering.causal_order(df, ("series",), ("ts", "id"), broadcast_rows=0)
    assert collected(out, "id") == {(s, i): r[2] for s, rows in by_series(rows).items() for i, r in enumerate(rows)}


def test_rows_of_the_hot_series_sit_in_several_partitions(spark):
    _, df = skewed(spark, 4000)
    sorted_rows = df.repartitionByRange(4, "series", "ts", "id")
    assert sorted_rows.where("series = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("chunk", [7, 16, 1 << 20])
def test_bounded_frames_cross_chunk_borders(numbered, chunk):
    want, df = numbered
    axis = Axis(("series",), chunk_rows=chunk)
    out = axis.bounded(
        df,
        {
            "prev": lambda w: F.lag("id").over(w),
            "near": lambda w: F.sum("id").over(w.rowsBetween(-4, 0)),
            "next": lambda w: F.sum("id").over(w.rowsBetween(0, 3)),
        },
        back=4,
        ahead=3,
    )
    got = {(r["series"], r["row_idx"]): (r["prev"], r["near"], r["next"]) for r in out.collect()}
    for s, rows in want.items():
        ids = [r[2] for r in rows]
        for i in range(len(ids)):
            prev = ids[i - 1] if i else None
            assert got[s, i] == (prev, sum(ids[max(0, i - 4): i + 1]), sum(ids[i: i + 4]))
    assert len(got) == sum(map(len, want.values()))


@pytest.mark.parametrize("chunk", [1, 9, 1 << 20])
def test_running_carries_over_chunks(numbered, chunk):
    want, df = numbered
    axis = Axis(("series",), chunk_rows=chunk)
    out = axis.running(df, sums={"total": F.col("id")}, lasts={"seen": F.col("x")}, maxima={"top": F.col("x")})
    got = {(r["series"], r["row_idx"]): (r["total"], r["seen"], r["top"]) for r in out.collect()}
    for s, rows in want.items():
        total, seen, top = 0, None, None
        for i, r in enumerate(rows):
            total += r[2]
            seen = r[3] if r[3] is not None else seen
            top = r[3] if top is None else top if r[3] is None else max(top, r[3])
            assert got[s, i] == (total, seen, top)


@pytest.mark.parametrize("alpha,initial", [(0.8, None), (0.8, 0.4), (0.3, None), (0.0, None), (0.95, 1.0)])
def test_ema_equals_the_recursion(spark, alpha, initial):
    rnd = random.Random(3)
    xs = [rnd.uniform(0, 1) for _ in range(9000)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "series string, row_idx long, x double")
    axis = Axis(("series",), chunk_rows=9500 if alpha == 0.95 else 4000)
    got = {r["row_idx"]: r["s"] for r in axis.ema(df, "s", F.col("x"), alpha, initial).collect()}
    state = initial
    for i, x in enumerate(xs):
        state = x if state is None or alpha == 0.0 else alpha * state + (1 - alpha) * x
        assert abs(got[i] - state) < 1e-12


def test_ema_refuses_a_chunk_that_is_too_short(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "series string, row_idx long, x double")
    with pytest.raises(ValueError):
        Axis(("series",), chunk_rows=100).ema(df, "s", F.col("x"), 0.8)
    with pytest.raises(ValueError):
        Axis(("series",), chunk_rows=4).bounded(df, {}, back=5)


def test_gap_blocks_do_not_depend_on_the_chunk(spark):
    df = spark.createDataFrame([(i, i if i < 50 else i + 100) for i in range(120)], "row_idx long, sec long").select(
        F.lit("a").alias("series"), "row_idx", F.timestamp_seconds("sec").alias("ts")
    )
    for chunk in (8, 1000):
        out = ordering.gap_blocks(df, Axis(("series",), chunk_rows=chunk), "ts", 2.0)
        assert sorted((r["row_idx"], r["block_id"]) for r in out.collect()) == [(i, int(i >= 50)) for i in range(120)]


def test_recent_rows_and_flags(numbered):
    want, df = numbered
    axis = Axis(("series",), chunk_rows=11)
    got = collected(ordering.recent_rows(df, axis, 3), "id")
    assert got == {(s, i): rows[i][2] for s, rows in want.items() for i in range(max(0, len(rows) - 3), len(rows))}
    flags = ordering.order_flags(df.withColumn("ts", F.timestamp_seconds("ts")), axis, "ts")
    dup = sum(len(rows) - len({r[1] for r in rows}) for rows in want.values())
    assert flags.where("is_duplicate").count() == dup and flags.where("is_back").count() == 0


def test_several_smoothed_columns_and_lags_over_them(spark):
    rnd = random.Random(13)
    rows = [(s, i, rnd.random(), rnd.random()) for s, n in (("a", 5000), ("b", 70)) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, row_idx long, x double, y double").repartition(3)
    axis = Axis(("series",), chunk_rows=2200)
    out = axis.emas(
        df, {"sx": (F.col("x"), None), "sy": (F.col("y"), 0.5)}, 0.8, {"late": lambda w: F.lag("sy", 15).over(w)}, back=15
    )
    got = {(r.series, r.row_idx): (r.sx, r.sy, r.late) for r in out.collect()}
    assert len(got) == len(rows)
    for series in ("a", "b"):
        sx, seen = None, [0.5]
        for _, i, x, y in sorted(r for r in rows if r[0] == series):
            sx = x if sx is None else 0.8 * sx + 0.2 * x
            seen.append(0.8 * seen[-1] + 0.2 * y)
            a, b, late = got[series, i]
            assert abs(a - sx) < 1e-12 and abs(b - seen[-1]) < 1e-12
            assert late is None if i < 15 else abs(late - seen[i - 14]) < 1e-12


def test_values_as_of_the_row_before(numbered):
    want, df = numbered
    out = Axis(("series",), chunk_rows=6).running(df, sums={"total": F.col("id")}, lasts={"seen": F.col("x")}, before=True)
    got = {(r["series"], r["row_idx"]): (r["total__before"], r["seen__before"]) for r in out.collect()}
    for s, rows in want.items():
        total, seen = 0, None
        for i, r in enumerate(rows):
            assert got[s, i] == (total, seen)
            total, seen = total + r[2], r[3] if r[3] is not None else seen


def test_rows_dealt_before_they_are_multiplied_smooth_alike_and_move_once(spark):
    runs, axis = spark.range(3).select(F.col("id").alias("run")), Axis(("run", "series"), chunk_rows=64)
    df = spark.range(500).select((F.col("id") % 2).alias("series"), F.floor(F.col("id") / 2).alias("row_idx"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    value = F.col("x") * (F.col("run") + 1)
    plain = axis.ema(df.crossJoin(F.broadcast(runs)), "s", value, 0.0001)
    dealt = axis.ema(axis.spread(df, 0.0001, ["series"]).crossJoin(F.broadcast(runs)), "s", value, 0.0001)
    assert dealt.columns == plain.columns and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count(" Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(run" not in plan
