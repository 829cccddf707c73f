"""Session set-up and the shared folder that multi-stage jobs write to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidegauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; `conf` overrides any of it."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    `spark.checkpoint.dir` wins, then the directory set on the context. Only a local-mode
    session may fall back to a temporary folder: on a cluster that folder would exist on
    one machine only, so the job is refused instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    on_context = spark.sparkContext.getCheckpointDir()
    if on_context:
        return on_context.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tidegauge-")
    return _LOCAL_DIRS[app]


#: Open scopes of `passing`, innermost last: the tags whose tables stay, and the tables to delete; None where `lasting` holds.
_SCOPES: list[tuple[frozenset[str], list[str]] | None] = []
#: Shuffle files of a query go when it ends, and not only when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as parquet in the shared folder and read it back.

    Cuts the lineage at a stage boundary; unlike a row-format checkpoint the result stays
    columnar, so later stages read only the columns they need, and a lost executor costs a
    re-read instead of a re-run. Within a scope of `passing` or `lasting` disk is spared: what
    was shuffled for the table goes once it is written, and it is packed more tightly.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for scope in reversed(_SCOPES):
        if scope is None:
            break
        if tag not in scope[0]:
            scope[1].append(path)
            break
    if _SCOPES:
        with unshuffled(spark):
            df.write.parquet(path, compression="zstd")
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; for those whose results are written, as nothing reads their shuffles again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def passing(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Tables written by `materialise` inside are deleted at the end, but those whose tag is `kept`.

    A DataFrame over the others must not leave the scope unwritten.
    """
    scope = frozenset(kept), []
    _SCOPES.append(scope)
    try:
        yield
    finally:
        _SCOPES.pop()
        for path in scope[1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def lasting() -> Iterator[None]:
    """Tables written inside stay, whatever scope of `passing` this is in."""
    _SCOPES.append(None)
    try:
        yield
    finally:
        _SCOPES.pop()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="tidegauge-code-"), "tidegauge")
    # A driver-side archive: Spark's own file server hands it to every executor.
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(app)
