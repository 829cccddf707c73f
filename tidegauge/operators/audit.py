"""Time-axis reports, table audits, label alignment and causality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.signals import ts_resolution
from tidegauge.operators.ordering import Axis, seconds_between
from tidegauge.session import materialise


def time_steps(df: DataFrame, axis: Axis, ts: str) -> DataFrame:
    """Rows with the seconds since the previous row of the series (null for the first)."""
    out = axis.bounded(df.select(*axis.series, axis.idx, ts), {"__prev": lambda w: F.lag(ts).over(w)}, back=1)
    return out.withColumn("delta_s", seconds_between(F.col("__prev"), F.col(ts))).drop("__prev")


def time_axis_report(df: DataFrame, axis: Axis, ts: str, max_gap_s: float, by: Sequence[str] | None = None) -> DataFrame:
    """Rows, range, order, repeats, modal step (smallest of the most frequent), gaps, blocks.

    The rows are in causal order, so a repeated stamp is a zero step. Steps are counted per
    value first; only the counts are ranked.
    """
    by = list(axis.series if by is None else by)
    steps = time_steps(df, axis, ts)
    d = F.col("delta_s")
    main = steps.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        (F.count_if(d < 0) == 0).alias("monotonic_increasing"),
        F.count_if(d == 0).alias("n_duplicate_timestamps"),
        F.count_if(d > max_gap_s).alias("n_gaps"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_gap_s"),
    )
    counts = steps.where(d.isNotNull()).groupBy(*by, "delta_s").agg(F.count("*").alias("k"))
    modal = counts.groupBy(*by).agg(F.min(F.struct((-F.col("k")).alias("k"), d.alias("d"))).alias("m"))
    return main.join(modal, by, "left").select(
        *main.columns, F.col("m.d").alias("modal_interval_s"), (F.col("n_gaps") + 1).alias("n_blocks")
    )


def missing_census(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells per column, and over all of them."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float")}
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if c in numeric else F.lit(False))
    counts = df.agg(
        F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(gone(c)).alias("n_missing")) for c in columns]).alias("a")
    )
    total = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["n_missing"])
    return counts.select(total.alias("n_missing_total"), F.inline("a"))


def check_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells per text column that do not read as numbers."""
    bad = lambda c: F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull())
    return df.agg(
        F.array(*[F.struct(F.lit(c).alias("column"), bad(c).alias("n_not_numeric")) for c in columns]).alias("a")
    ).select(F.inline("a")).withColumn("is_numeric", F.col("n_not_numeric") == 0)


def non_numeric_columns(df: DataFrame) -> list[str]:
    """Columns whose declared type is not a number."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [n for n, t in df.dtypes if t not in numbers and not t.startswith("decimal")]


def load_report(
    axis_report: DataFrame, declared_rows: int | None, declared_range: tuple[str, str] | None,
    n_missing: Column, expected_interval_s: float | None = None,
) -> DataFrame:
    """Declared against measured facts, and the list of findings."""
    rows_ok = F.lit(None).cast("boolean") if declared_rows is None else F.col("n_rows") == declared_rows
    if declared_range is None:
        range_ok = F.lit(None).cast("boolean")
    else:
        lo, hi = (F.lit(s).cast("timestamp_ntz") for s in declared_range)
        range_ok = (F.col("first_ts") == lo) & (F.col("last_ts") == hi)
    say = lambda when, *parts: F.when(when, F.concat(*parts))
    off = F.lit(False) if expected_interval_s is None else F.col("modal_interval_s") != expected_interval_s
    findings = F.array_compact(
        F.array(
            say(~rows_ok, F.lit("row count differs")),
            say(F.col("n_duplicate_timestamps") > 0, F.col("n_duplicate_timestamps").cast("string"), F.lit(" duplicate timestamps")),
            say(off, F.lit("modal interval differs")),
            say(F.col("n_gaps") > 0, F.col("n_gaps").cast("string"), F.lit(" gaps; "), F.col("n_blocks").cast("string"), F.lit(" blocks")),
            say(~range_ok, F.lit("time range differs")),
            say(n_missing > 0, n_missing.cast("string"), F.lit(" missing cells")),
        )
    )
    return axis_report.withColumns(
        {
            "row_count_matches": rows_ok, "time_range_matches": range_ok,
            "findings": F.array_join(findings, "|"),
        }
    )


#: Doubles are shown as whole millionths, the same text in any engine; beyond this size the text is "huge".
_MICRO, _HUGE = 1e6, 9e12
_MISSING = "\\N"


def _number_text(x: Column) -> Column:
    """A float as its nearest whole number of millionths (halves up); null stays null."""
    micro = F.floor(x.cast("double") * _MICRO + F.lit(0.5)).cast("string")
    return F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) >= _HUGE, F.lit("huge")).otherwise(micro)


def fixed_text(c: Column, kind: T.DataType) -> Column:
    """One text form of a value, so that equal values are equal text wherever it was made; null stays null."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return _number_text(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: F.coalesce(fixed_text(x, kind.elementType), F.lit(_MISSING))), ",")
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def dataset_audit(tables: Mapping[str, DataFrame], max_values: int = 12) -> DataFrame:
    """One row per (table, column): rows, missing cells, and for columns of few values their number and distribution.

    A first job reads every table once and sketches the distinct values of each column; a column whose estimate is far
    beyond `max_values` is wide, and only what is not is counted by value, in a second job over those columns alone. So no
    wide column is ever shuffled, and what grows is a count per (narrow column, value) and task. The estimate of so few
    values is exact but for a collision of hashes, and the number of values is taken from the counts.
    """

    def sketched(name: str, df: DataFrame) -> DataFrame:
        cols = [(f.name, fixed_text(F.col(f.name), f.dataType)) for f in df.schema.fields]
        facts = [
            F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_if(x.isNull()).alias("n_missing"), F.hll_sketch_estimate(F.hll_sketch_agg(x, 14)).alias("about"))
            for c, x in cols
        ]
        return df.agg(F.lit(name).alias("table_name"), F.array(*facts).alias("a")).select("table_name", F.inline("a"))

    facts = materialise(reduce(DataFrame.unionByName, [sketched(n, d) for n, d in tables.items()]), "facts")
    narrow: dict[str, list[str]] = {}
    for r in facts.where(F.col("about") <= 2 * max_values).select("table_name", "column").collect():  # columns, not rows
        narrow.setdefault(r["table_name"], []).append(r["column"])

    def counted(name: str, cols: list[str]) -> DataFrame:
        df = tables[name]
        text = df.select(*[fixed_text(F.col(c), df.schema[c].dataType).alias(c) for c in cols])
        long = text.unpivot([], cols, "column", "value").groupBy("column", "value").agg(F.count("*").alias("k"))
        return long.select(F.lit(name).alias("table_name"), "column", "value", "k")

    schema = "table_name string, column string, n_unique long, distribution string"
    shown = facts.sparkSession.createDataFrame([], schema)
    if narrow:
        long = reduce(DataFrame.unionByName, [counted(n, c) for n, c in narrow.items()]).where(F.col("value").isNotNull())
        d = F.array_sort(F.collect_list(F.concat_ws(":", "value", F.col("k").cast("string"))))  # 2 * max_values and a few at most
        shown = long.groupBy("table_name", "column").agg(F.count("*").alias("n_unique"), F.array_join(d, "|").alias("distribution"))
    few = F.coalesce("n_unique", F.when(F.col("n_rows") == F.col("n_missing"), F.lit(0)))
    out = facts.join(shown, ["table_name", "column"], "left").withColumn("n", few)
    is_wide = F.col("n").isNull() | (F.col("n") > max_values)
    return out.select(
        "table_name", "column", "n_rows", "n_missing", is_wide.alias("is_wide"), F.when(~is_wide, F.col("n")).alias("n_unique"),
        F.when(~is_wide, F.col("distribution")).alias("distribution"), F.coalesce(F.col("n") <= 1, F.lit(False)).alias("zero_variance"),
    )


def table_facts(tables: Mapping[str, DataFrame], time_columns: Mapping[str, str]) -> DataFrame:
    """One row per table: rows, columns, an id of the set of column names, and the range and number of its time stamps."""

    def one(name: str, df: DataFrame) -> DataFrame:
        ts = time_columns.get(name)
        stamps = [F.min(ts), F.max(ts), F.count_distinct(F.col(ts))] if ts else [F.lit(None).cast("timestamp_ntz")] * 2 + [F.lit(None).cast("long")]
        return df.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
            F.md5(F.lit("|".join(sorted(df.columns)))).alias("column_set_id"), F.lit(ts).cast("string").alias("time_column"),
            *[x.alias(n) for x, n in zip(stamps, ("first_ts", "last_ts", "n_stamps"))],
        )

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def file_facts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table read from files: their number and bytes, from the reader's hidden column."""

    def one(name: str, df: DataFrame) -> DataFrame:
        files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(F.max("b").alias("b"))
        return files.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_files"), F.sum("b").alias("n_bytes"))

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def interval_histogram(df: DataFrame, axis: Axis, ts: str, top: int = 4) -> DataFrame:
    """The most frequent steps between consecutive rows."""
    steps = time_steps(df, axis, ts).where(F.col("delta_s").isNotNull())
    return steps.groupBy("delta_s").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "delta_s").limit(top)


def table_chronology(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Tables by their first time stamp."""
    spans = [
        df.agg(F.lit(name).alias("table_name"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_rows"))
        for name, (df, ts) in tables.items()
    ]
    return reduce(DataFrame.unionByName, spans).orderBy("first_ts", "table_name")


def digest_tree(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Order-free digests of every table: table_name, schema_id, node, n_rows, hi, lo.

    A row's digest is the MD5 of its fixed text, columns by name. Rows fall into 256 buckets by its first two digits; a bucket's
    digest are the sums of both 64-bit halves, so repeats count, order and partitions don't. The sums go up a tree of 16 by 16
    nodes ("ab", "a", "") to the table's own, as sums of sums. Tasks add up before the shuffle: at most 256 rows a task and table.
    """

    def buckets(name: str, df: DataFrame) -> DataFrame:
        cols = sorted(df.columns)
        row = F.md5(F.concat_ws("\x1f", *[F.coalesce(fixed_text(F.col(c), df.schema[c].dataType), F.lit(_MISSING)) for c in cols]))
        schema_id = F.md5(F.lit("|".join(cols)))
        half = lambda at: F.sum(F.conv(F.substring("row", at, 16), 16, 10).cast("decimal(38,0)"))
        out = df.select(row.alias("row")).groupBy(F.substring("row", 1, 2).alias("node"))
        return out.agg(F.count("*").alias("n_rows"), half(1).alias("hi"), half(17).alias("lo")).select(
            F.lit(name).alias("table_name"), schema_id.alias("schema_id"), "node", "n_rows", "hi", "lo"
        )

    leaves = materialise(reduce(DataFrame.unionByName, [buckets(n, d) for n, d in tables.items()]), "digests")
    sums = [F.sum(c).cast(t).alias(c) for c, t in (("n_rows", "long"), ("hi", "decimal(38,0)"), ("lo", "decimal(38,0)"))]
    up = lambda digits: leaves.groupBy("table_name", "schema_id", F.substring("node", 1, digits).alias("node")).agg(*sums)
    return leaves.select("table_name", "schema_id", "node", "n_rows", "hi", "lo").unionByName(up(1)).unionByName(up(0))


def duplicate_tables(tree: DataFrame) -> DataFrame:
    """Every table of a `digest_tree` with the names of all that have the same columns and the same rows, itself included."""
    roots = tree.where("node = ''").drop("node")
    same = ["schema_id", "n_rows", "hi", "lo"]
    names = roots.groupBy(*same).agg(F.array_join(F.array_sort(F.collect_list("table_name")), "|").alias("equal_tables"), F.count("*").alias("n_equal"))
    content = F.concat_ws("/", F.col("hi").cast("string"), F.col("lo").cast("string")).alias("content_id")
    return roots.join(names, same).select("table_name", "schema_id", "n_rows", content, "equal_tables", "n_equal")


def table_differences(tree: DataFrame) -> DataFrame:
    """Pairs of tables with the same columns and different rows: in how many buckets, which is the first, and rows on either side.

    Only below a node that differs are its children compared, so what is alike is never looked into.
    """
    def pairs(among: DataFrame) -> DataFrame:
        names = among.select("table_name", "schema_id").distinct()
        return names.alias("l").join(names.alias("r"), (F.col("l.schema_id") == F.col("r.schema_id")) & (F.col("l.table_name") < F.col("r.table_name"))).select(
            F.col("l.table_name").alias("left_table"), F.col("r.table_name").alias("right_table")
        )

    side = lambda x, name: x.select(F.col("table_name").alias(f"{name}_table"), "node", F.struct("n_rows", "hi", "lo").alias(name))
    open_ = pairs(tree).withColumn("node", F.lit(""))
    for digits in (0, 1, 2):
        level = tree.where(F.length("node") == digits)
        empty = F.struct(F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("decimal(38,0)").alias("hi"), F.lit(0).cast("decimal(38,0)").alias("lo"))
        parent = open_.withColumnRenamed("node", "parent")
        below = level.select("node").distinct().withColumn("parent", F.substring("node", 1, max(0, digits - 1)))
        both = parent.join(below, "parent") if digits else open_
        both = both.join(side(level, "left"), ["left_table", "node"], "left").join(side(level, "right"), ["right_table", "node"], "left")
        both = both.withColumns({c: F.coalesce(c, empty) for c in ("left", "right")}).where(F.col("left") != F.col("right"))
        open_ = both.select("left_table", "right_table", "node", *(["left", "right"] if digits == 2 else []))
    return open_.groupBy("left_table", "right_table").agg(
        F.count("*").alias("n_buckets"), F.min("node").alias("first_bucket"), F.sum("left.n_rows").alias("left_rows"), F.sum("right.n_rows").alias("right_rows")
    )


def schema_diff(left: DataFrame, right: DataFrame) -> dict[str, object]:
    """Columns missing from the right, extra in it, and whether shared ones change order."""
    a, b = left.columns, right.columns
    shared_a, shared_b = [c for c in a if c in b], [c for c in b if c in a]
    return {
        "missing": [c for c in a if c not in b],
        "extra": [c for c in b if c not in a],
        "reordered": shared_a != shared_b,
    }


def stamp_set_diff(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys found on one side only (order-insensitive set comparison)."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, list(key), "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, list(key), "left_anti").withColumn("side", F.lit("right_only"))
    )


def align_labels(data: DataFrame, labels: DataFrame, idx: str, stamp: str) -> DataFrame:
    """Do data row i and label row i carry the same stamp? One row of counts and verdicts."""
    a = data.select(F.col(idx), F.col(stamp).alias("__a"))
    b = labels.select(F.col(idx), F.col(stamp).alias("__b"))
    both = a.join(b, idx, "full_outer")
    rows = both.agg(
        F.count("__a").alias("n_data"),
        F.count("__b").alias("n_labels"),
        F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_mismatched"),
        F.min(F.when(~F.col("__a").eqNullSafe(F.col("__b")), F.col(idx))).alias("first_mismatch"),
    )
    only = stamp_set_diff(a.select(F.col("__a").alias("s")), b.select(F.col("__b").alias("s")), ["s"])
    sides = only.where(F.col("s").isNotNull()).agg(
        F.count_if(F.col("side") == "left_only").alias("n_data_only"),
        F.count_if(F.col("side") == "right_only").alias("n_labels_only"),
    )
    repeats = b.agg((F.count("__b") - F.count_distinct("__b")).alias("n_duplicate_labels"))
    out = rows.join(sides, F.lit(True)).join(repeats, F.lit(True))  # three one-row aggregates
    return out.withColumns(
        {
            "counts_equal": F.col("n_data") == F.col("n_labels"),
            "stamps_unique": F.col("n_duplicate_labels") == 0,
            "elementwise_equal": F.col("n_mismatched") == 0,
            "sets_equal": (F.col("n_data_only") + F.col("n_labels_only")) == 0,
        }
    )


def class_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share per class (missing is its own class) and the number of classes."""
    counts = df.groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("__all"),
        F.count("label").alias("n_classes"),
    )
    out = counts.join(totals, list(by)) if by else counts.crossJoin(F.broadcast(totals))  # one row
    return out.select(*by, "label", "n", (F.col("n") / F.col("__all")).alias("rate"), "n_classes", (F.col("n_classes") >= 2).alias("usable"))


def positive_runs(df: DataFrame, axis: Axis, label: str, positive: int = 1) -> DataFrame:
    """Number of unbroken runs of the positive class per series."""
    hit = F.col(label) == positive
    out = axis.bounded(df, {"__was": lambda w: F.lag(label).over(w)}, back=1)
    starts = hit & ~F.coalesce(F.col("__was") == positive, F.lit(False))
    return out.groupBy(*axis.series).agg(F.count_if(starts).alias("n_runs"), F.count_if(hit).alias("n_positive"))


def stamp_resolution(df: DataFrame, ts: str) -> DataFrame:
    """Counts of stamps with non-zero parts, and the resolution they imply."""
    t = F.col(ts)
    out = df.agg(
        F.count_if((F.second(t) != 0) | (F.unix_micros(t.cast("timestamp")) % 1_000_000 != 0)).alias("with_seconds"),
        F.count_if(F.minute(t) != 0).alias("with_minutes"),
        F.count_if(F.hour(t) != 0).alias("with_hours"),
        F.count_distinct(t).alias("n_distinct"),
        F.count("*").alias("n_rows"),
    )
    return out.withColumn("resolution", ts_resolution(F.col("with_seconds"), F.col("with_minutes"), F.col("with_hours")))


def assert_causal(df: DataFrame, ts: str, role: str = "role", baseline: str = "baseline_train", inference: str = "inference") -> DataFrame:
    """Measured end of the baseline against the measured start of the inference role."""
    r = F.col(role)
    out = df.agg(
        F.max(F.when(r == baseline, F.col(ts))).alias("baseline_end"),
        F.min(F.when(r == inference, F.col(ts))).alias("inference_start"),
    )
    return out.withColumn("is_causal", F.col("baseline_end") <= F.col("inference_start"))


def pool_baselines(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Rows of several baselines stacked for statistics only; their order is meaningless."""
    return reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])
