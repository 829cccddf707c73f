"""What the text operators share: reading, typed column checks and per-worker caches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import ship_package

#: Words that white space bounds: ASCII white space only.
SPACES = " \t\n\x0b\x0c\r"
#: The same for Java's and DuckDB's patterns.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Buckets of the table that tells which rows a join needs: at most so many numbers are broadcast.
BUCKETS = 1 << 20
#: Entries that a worker keeps of words it has met before; beyond that it starts anew.
CACHE_ENTRIES = 400_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the named columns: whatever else the table holds cannot clash with results."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bucket(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def split_by(df: DataFrame, keys: Sequence[Column], some: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """`df` in two: the rows that may have their keys in `some`, and the rest, which surely don't.

    What is broadcast are buckets of hashes, at most BUCKETS numbers of 8 bytes, whatever the size of `some`: with few keys nearly
    all of `df` is spared a join, with very many none of it, and the result of joining the first part only is the same.
    """
    place = free_name(df, "__bucket")
    told = F.broadcast(some.select(bucket(*[F.col(c) for c in names]).alias(place)).distinct())
    placed = df.withColumn(place, bucket(*keys))
    return placed.join(told, place, "left_semi").drop(place), placed.join(told, place, "left_anti").drop(place)


_HELD: dict[str, object] = {}


def only(key: str, make: Callable):
    """make(), kept in the Python worker until another key is asked for: workers outlive stages, tables of words should not."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def built(kind: Callable, content: str):
    """kind(content), built once in a Python worker for as long as nothing else is."""
    return only(f"{kind.__qualname__}:{hash(content)}", lambda: kind(content))


class Remembered(dict):
    """A dict that computes missing values and starts anew when it has grown to `bound`."""

    def __init__(self, compute: Callable, bound: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.bound = compute, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.compute(key)
        return value
