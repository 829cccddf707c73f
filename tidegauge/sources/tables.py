"""Reading time-ordered tables: typed scans, time ranges, roles, labels, feature lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.profile import unpivot
from tidegauge.session import materialise

# Roles a table or a time span may play.
ROLES = ("baseline_train", "baseline_validation", "inference")


def scan_delimited(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", time_column: str | None = None
) -> DataFrame:
    """Delimited text with a header; names are stripped, the time column stays text.

    The schema is declared, so no extra pass infers it and column pruning reaches the reader.
    """
    fields = [
        T.StructField(f.name, T.StringType() if f.name == time_column else f.dataType) for f in schema.fields
    ]
    df = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("sep", sep)
        .option("enforceSchema", True)
        .csv(path)
    )
    return df.toDF(*[c.strip() for c in df.columns])


#: Column in which the reader keeps a line that does not fit the schema.
_LINE = "__line"


def scan_quarantined(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", time_column: str | None = None, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the declared schema, and the lines that don't, each with its reason.

    Instead of nulls in place of what could not be read, a line with too few or too many fields, or with a field that is not of
    its type, goes to quarantine as a whole: `line` and `reason` ("too few fields", "too many fields", "not a <type>: <column>").
    The scan is written once, since the reader parses only what a query asks for and would judge a line by that alone.
    """
    fields = [T.StructField(f.name.strip(), T.StringType() if f.name == time_column else f.dataType) for f in schema.fields]
    read = spark.read.schema(T.StructType([*fields, T.StructField(_LINE, T.StringType())])).option("header", header).option("sep", sep)
    every = materialise(read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).csv(path), "scanned")
    line = F.col(_LINE)
    good = every.where(line.isNull()).drop(_LINE)
    cells = F.from_csv(line, ", ".join(f"c{k} string" for k in range(len(fields) + 1)), {"sep": sep})
    bad = every.where(line.isNotNull()).select(line.alias("line"), cells.alias("c"), (F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit("")))).alias("n"))
    told = None
    for k, f in enumerate(fields):
        if not isinstance(f.dataType, T.StringType):
            wrong = F.col(f"c.c{k}").isNotNull() & F.expr(f"try_cast(trim(c.c{k}) AS {f.dataType.simpleString()})").isNull()
            told = F.when(wrong, F.lit(f"not a {f.dataType.simpleString()}: {f.name}")) if told is None else told.when(wrong, F.lit(f"not a {f.dataType.simpleString()}: {f.name}"))
    # Separators inside quotes are no fields: what the parser made of the line decides, the count only where it is one too many.
    few = F.col(f"c.c{len(fields) - 1}").isNull() & (F.col("n") < (len(fields) - 1) * len(sep))
    many = F.col(f"c.c{len(fields)}").isNotNull()
    reason = F.when(few, F.lit("too few fields")).when(many, F.lit("too many fields")).otherwise(F.coalesce(*([told] if told is not None else []), F.lit("unreadable")))
    return good, bad.select("line", reason.alias("reason"))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_ts_strict(df: DataFrame, column: str, fmt: str = "yyyy-MM-dd HH:mm:ss", name: str = "ts") -> DataFrame:
    """Parse with exactly one format; what does not parse becomes null and is reported by
    `unparsed` before anything relies on it."""
    return df.withColumn(name, F.try_to_timestamp(F.trim(column), F.lit(fmt)))


def unparsed(df: DataFrame, column: str, name: str = "ts", samples: int = 5) -> DataFrame:
    """How many stamps failed to parse, and the smallest few of them as text."""
    bad = F.col(name).isNull()
    worst = df.where(bad).select(F.coalesce(F.col(column), F.lit("")).alias("s")).distinct().orderBy("s").limit(samples)
    shown = worst.agg(F.array_join(F.array_sort(F.collect_list("s")), "|").alias("samples"))  # at most `samples` rows
    return df.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_unparsed")).join(shown, F.lit(True))


def require_parsed(df: DataFrame, column: str, name: str = "ts") -> None:
    """Raise when any stamp failed to parse, naming a few of them."""
    row = unparsed(df, column, name).first()
    if row.n_unparsed:
        raise ValueError(f"{row.n_unparsed} stamps do not match the format, such as {row.samples}")


def time_range(df: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    """Rows with lo <= ts <= hi; a plain comparison, so it reaches the file reader."""
    kind = dict(df.dtypes)[ts]
    return df.where(F.col(ts).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))


def assign_role(ts: Column, train_end: str, validation_end: str, kind: str = "timestamp_ntz") -> Column:
    """Role by time: training baseline, then validation, then the inference stream."""
    at = lambda s: F.lit(s).cast(kind)
    return (
        F.when(ts < at(train_end), F.lit(ROLES[0]))
        .when(ts < at(validation_end), F.lit(ROLES[1]))
        .otherwise(F.lit(ROLES[2]))
    )


def role_counts(df: DataFrame, role: str = "role") -> DataFrame:
    known = F.col("role").isin(*ROLES)
    return df.groupBy(F.col(role).alias("role")).agg(F.count("*").alias("n_rows")).withColumn("known", known)


def check_roles(files: Mapping[str, str]) -> str:
    """Refuse unknown roles and anything but one inference stream; returns its key."""
    unknown = {k: r for k, r in files.items() if r not in ROLES}
    if unknown:
        raise ValueError(f"unknown roles {unknown}")
    streams = [k for k, r in files.items() if r == "inference"]
    if len(streams) != 1:
        raise ValueError(f"exactly one inference stream is needed, got {streams}")
    return streams[0]


def scan_by_role(spark: SparkSession, files: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Several parquet inputs as one table with their role as a column."""
    check_roles({k: role for k, (_, role) in files.items()})
    parts = [scan_parquet(spark, path).withColumn("role", F.lit(role)) for path, role in files.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def extract_labels(column: str) -> Column:
    """Integer label; missing or not numeric counts as 0."""
    return F.coalesce(F.expr(f"try_cast(`{column}` AS int)"), F.lit(0))


def feature_columns(
    df: DataFrame, reserved: Sequence[str], exclude: Sequence[str] = (), include: Sequence[str] | None = None
) -> list[str]:
    """Feature names: all but the reserved and excluded ones, or exactly the listed ones."""
    left = [c for c in df.columns if c not in {*reserved, *exclude}]
    if include is None:
        return left
    unknown = [c for c in include if c not in left]
    if unknown:
        raise ValueError(f"included columns are not available as features: {unknown}")
    return [c for c in left if c in set(include)]


def long_features(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (key, channel)."""
    return unpivot(df, columns, key)
