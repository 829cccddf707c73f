"""Conversation prefix trie by whole-sequence collapse.

Sequences of turns become running hashes: the key of a prefix is its length and the exclusive or of two 64-bit hashes
of (place, turn), so equal prefixes have equal keys wherever they stand and a prefix is known from one narrow row.
Conversations with the same last key are one weighted sequence from then on, with a list of ends. A sequence whose key
is a proper prefix of another one is dropped by an anti-join; what stays are the leaves. Weighted prefixes of the
distinct sequences are aggregated to nodes.

Sums over subtrees need no recursion: every node is owned by the smallest leaf below it, and a subtree is the rest of its
owner's own stretch and the whole stretches of the other leaves that pass through it. So one further aggregation over the
leaves' prefixes is enough, and the work stays linear in the turns of distinct sequences.

A conversation may hold a third of all rows: turns are ordered by a range sort and numbered from counts, running hashes and
sums go in chunks with carries. As many conversations may be equal: their ids are sorted over all tasks and packed to pieces
of text, and only the pieces of one sequence are hashed one after the other, as SHA-256 demands.

Null roles and texts are empty. Turns with equal numbers are ordered by role, then by a hash of the text. Repeated rows are
turns of their own. Rows without conv_id belong to no conversation. An empty table has no nodes, not even a root. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import Axis, causal_order
from tidegauge.session import materialise

#: Conversations of a block, whose first one gives the others their beginning; most turns that it gives, plus one.
BLOCK, HEADS = 100, 6
#: Turns of a conversation that one window holds; characters of a piece of an end list.
CHUNK, PIECE = 1 << 16, 1 << 16
KEY = ["depth", "x1", "x2"]
_NONE = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """conv_id, i (from 0), t1 and t2 (hashes of role and text), chars (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("told"), "turn", role.alias("role"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.concat(F.md5(role), F.md5(text))).alias("t2"), F.length(text).cast("long").alias("chars"),
    )
    return causal_order(narrow, ["conv_id"], ["told", "turn", "role", "t1", "t2"], "i").select("conv_id", "i", "t1", "t2", "chars")


def given(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, pos from 1, t1, t2, chars) with the beginnings of blocks put in, and all conv_ids.

    `own` is read three times: write it first.
    """
    first, h = F.col("conv_id") - F.col("conv_id") % BLOCK, given(F.col("conv_id"))
    starts = own.where((F.col("conv_id") == first) & (F.col("i") < HEADS - 1)).groupBy(F.col("conv_id").alias("first"))
    starts = starts.agg(F.sort_array(F.collect_list(F.struct("i", "t1", "t2", "chars"))).alias("start"))
    ids = own.select("conv_id").distinct().withColumn("first", first)
    headed = ids.join(starts, "first", "left").select("conv_id", F.slice(F.coalesce("start", F.array().cast("array<struct<i:bigint,t1:bigint,t2:bigint,chars:bigint>>")), 1, h.cast("int")).alias("start"))
    headed = materialise(headed, "heads")
    heads = headed.select("conv_id", F.explode("start").alias("s")).select("conv_id", (F.col("s.i") + 1).alias("pos"), "s.t1", "s.t2", "s.chars")
    rest = own.where(F.col("i") >= h).join(headed.select("conv_id", F.size("start").alias("n")), "conv_id")
    rest = rest.select("conv_id", (F.col("n") + F.col("i") - h + 1).cast("long").alias("pos"), "t1", "t2", "chars")
    return heads.unionByName(rest), headed.select("conv_id")


def prefixes(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, x1, x2 (with depth the key of the prefix), p1, p2 (the same of the parent), chars of the last turn."""
    c, e = F.floor((F.col("pos") - 1) / F.lit(chunk)).alias("chunk"), [F.xxhash64("pos", "t1"), F.xxhash64("t2", "pos")]
    rows = materialise(sequences.select("conv_id", "pos", "chars", c, e[0].alias("e1"), e[1].alias("e2")), "sequences")
    totals = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "chunk", *[F.bit_xor(f"s{k}").over(before).alias(f"c{k}") for k in (1, 2)]).where("chunk > 0")
    upto = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.bit_xor(f"e{k}").over(upto).alias(f"l{k}") for k in (1, 2)])
    whole = local.join(carried, ["conv_id", "chunk"], "left")
    x = {k: F.col(f"l{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in (1, 2)}
    return whole.select(
        "conv_id", F.col("pos").alias("depth"), x[1].alias("x1"), x[2].alias("x2"),
        x[1].bitwiseXOR(F.col("e1")).alias("p1"), x[2].bitwiseXOR(F.col("e2")).alias("p2"), "chars",
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that stand together under a key, joined to pieces; rows (depth, x1, x2, conv_id) arrive sorted."""
    run, ids, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": run[0], "x1": run[1], "x2": run[2], "low": int(ids[0]), "part": ",".join(ids)}], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in (*KEY, "low")] + [("part", pa.string())])
    for batch in batches:
        done: list[pa.RecordBatch] = []
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if key != run or size >= PIECE:
                if ids:
                    done.append(piece())
                run, ids, size = key, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's pieces; rows (depth, x1, x2, low, part) arrive sorted by all but the part."""
    run, digest = None, hashlib.sha256()
    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("ends_sha256", pa.string())])
    for batch in batches:
        rows = []
        for *key, _, part in zip(*(c.to_pylist() for c in batch.columns)):
            if key != run:
                if run is not None:
                    rows.append((*run, digest.hexdigest()))
                run, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], schema=schema)
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*run, digest.hexdigest())], schema=schema)


def end_lists(members: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256: the digest of the ascending, comma-joined conv_ids of each key."""
    keys = "depth long, x1 long, x2 long"
    dealt = members.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = dealt.mapInArrow(_packed, f"{keys}, low long, part string")
    together = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "low")
    return together.mapInArrow(_hashed, f"{keys}, ends_sha256 string")


def trie(sequences: DataFrame, ids: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `sequences`: conv_id, pos (1, 2, ...), t1, t2, chars; `ids`: every conv_id once, also of those without turns.
    """
    rows = materialise(prefixes(sequences, chunk), "prefixes")
    last = rows.select("conv_id", F.struct(*KEY).alias("k")).unionByName(ids.select("conv_id", F.struct(*[F.lit(0).cast("long").alias(c) for c in KEY]).alias("k")))
    members = materialise(last.groupBy("conv_id").agg(F.max("k").alias("k")).select("conv_id", "k.*"), "members")
    ends = materialise(end_lists(members), "ends")
    weighted = members.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    weighted = materialise(weighted.withColumnRenamed("depth", "size"), "weighted")
    own = rows.join(weighted.where("size > 0").select(F.col("low").alias("conv_id"), "size", "n"), "conv_id")
    own = materialise(own, "own")
    proper = own.where("depth < size").select(F.col("depth").alias("size"), "x1", "x2").distinct()
    leaves = weighted.where("size > 0").join(proper, ["size", "x1", "x2"], "left_anti").select(F.col("low").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    own = materialise(own.join(leaves, "conv_id", "left"), "leaves")
    nodes = own.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"),
        ((F.sum("n") - 1) * F.max("chars")).alias("saved"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = materialise(nodes, "nodes")
    owned = materialise(nodes.groupBy("owner").agg(F.sum("saved").alias("stretch"), F.min("depth").alias("from")), "owned")
    through = own.where("leaf = 1").join(owned.select(F.col("owner").alias("conv_id"), "stretch"), "conv_id").groupBy(*KEY).agg(F.sum("stretch").alias("through"))
    told = nodes.join(owned, "owner").withColumn("at", F.col("depth") - F.col("from"))
    told = Axis(("owner",), "at", chunk).running(materialise(told, "told"), {"upto": F.col("saved")})
    told = told.withColumn("rest", F.col("saved") - F.col("upto")).select(*KEY, "conv_id", "p1", "p2", "n_convs", "n_leaves", "rest")
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"))
    full = told.join(through, KEY).join(children, KEY, "left").join(ends, KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    zero, none = F.lit(0).cast("long"), F.lit(_NONE)
    # The root is one row of sums over whole tables; its children would be a hot key of the joins.
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    sums = nodes.agg(F.sum((F.col("depth") == 1).cast("long")).alias("n_children"), F.sum("saved").alias("saved_tokens")).first()
    n_leaves, listed = leaves.count(), ends.where("depth = 0").select("ends_sha256").first()
    columns = {"conv_id": top["conv_id"], "depth": 0, "parent_conv_id": None, "n_convs": top["n_convs"], "n_children": sums["n_children"] or 0, "n_leaves": max(1, n_leaves), "saved_tokens": sums["saved_tokens"] or 0}
    root = members.sparkSession.range(1 if top["n_convs"] else 0).select(
        *[F.lit(v).cast("long").alias(c) for c, v in columns.items()], F.lit(listed[0] if listed else _NONE).alias("ends_sha256")
    )
    return root.unionByName(full.select(
        "conv_id", "depth", F.coalesce("parent", F.lit(top["conv_id"])).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", (F.col("rest") + F.col("through")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    ))


def conversation_trie(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The trie of the rebuilt conversations of `df` (conv_id, turn, role, text)."""
    sequences, ids = rebuilt(materialise(turns(df), "turns"))
    return trie(sequences, ids, chunk)
