"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) on a ring of 64-bit hashes; a row's key lands on an arc and belongs to the
shard whose point ends it. A shard takes no more rows than its load bound; what overflows continues clockwise to the
next points, past full shards. With the bounds set to the exact quotas (the row count divided by the shards, the
remainder one row each to the first shards of a fixed order) the counts differ by one at most, whatever the keys.

Which rows overflow is settled on counts: one number per arc (shards x points of them, whatever the table) goes to the
driver, which lays out runs of each arc's rows, and rows are numbered along the ring by a range sort. So a key that
holds a third of all rows is one arc's long run, cut where shards fill up, and no task holds a shard.

Rows with equal keys are ordered by text checksum and size, then as they are read. A null key is a key like any other;
a null text has size 8 and the checksum of the empty text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import causal_order

#: Points of each shard on the ring.
POINTS = 128


def ring(n_shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise; positions are signed 64-bit."""
    out = []
    for shard in range(n_shards):
        for point in range(points):
            digest = hashlib.blake2b(f"{shard}/{point}".encode(), digest_size=8).digest()
            out.append((int.from_bytes(digest, "little", signed=True), shard))
    return sorted(out)


def quotas(total: int, n_shards: int) -> list[int]:
    """The load bounds: at most one apart, their sum the number of rows."""
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def lay_out(counts: dict[int, int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first row, end, shard, first slot): every arc fills its own shard, the rest goes on clockwise.

    Arcs are served in ring order, first all of them at home, then what overflowed.
    """
    room, used, runs, over = list(bounds), [0] * len(bounds), [], []

    def place(arc: int, first: int, left: int, shard: int) -> int:
        n = min(left, room[shard])
        if n:
            runs.append((arc, first, first + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    for arc in sorted(counts):
        put = place(arc, 0, counts[arc], owners[arc])
        if put < counts[arc]:
            over.append((arc, put, counts[arc] - put))
    for arc, first, left in over:
        at = arc
        while left:
            at = (at + 1) % len(owners)
            put = place(arc, first, left, owners[at])
            first, left = first + put, left - put
    return runs


def assign(df: DataFrame, n_shards: int = 24, points: int = POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: one more shard may move rows anywhere)."""
    spark = df.sparkSession
    nodes = ring(n_shards, points)
    positions, owners = np.array([p for p, _ in nodes]), [s for _, s in nodes]

    @F.pandas_udf("int")
    def arc_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, keys.to_numpy(), "left") % len(positions)).astype("int32")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col).cast("string")).alias("key"),
    )
    rows = rows.withColumn("arc", arc_of("key")).withColumn("read", F.monotonically_increasing_id())
    placed = causal_order(rows, ("arc",), ("key", "text_crc32", "size", "read"), "at")
    counts = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # one row per virtual node
    runs = lay_out(counts, owners, quotas(sum(counts.values()), n_shards))
    table = spark.createDataFrame(runs, "arc int, first long, end long, shard int, slot0 long")
    near = F.broadcast(table)  # at most virtual nodes + shards x virtual nodes rows
    inside = (placed["arc"] == near["arc"]) & (placed["at"] >= near["first"]) & (placed["at"] < near["end"])
    return placed.join(near, inside).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_one_by_one(keys: list[int], n_shards: int, points: int = POINTS) -> list[int]:
    """The same law key by key, for tests: home first, then clockwise, in ring order."""
    nodes = ring(n_shards, points)
    positions, room = [p for p, _ in nodes], quotas(len(keys), n_shards)
    arcs = [bisect_left(positions, k) % len(nodes) for k in keys]
    out, order = [-1] * len(keys), sorted(range(len(keys)), key=lambda i: (arcs[i], keys[i]))
    for step in range(len(nodes) + 1):
        for i in order:
            if out[i] < 0 and step == 0 and room[s := nodes[arcs[i]][1]]:
                out[i], room[s] = s, room[s] - 1
    for i in order:
        at = arcs[i]
        while out[i] < 0:
            at = (at + 1) % len(nodes)
            if room[s := nodes[at][1]]:
                out[i], room[s] = s, room[s] - 1
    return out
