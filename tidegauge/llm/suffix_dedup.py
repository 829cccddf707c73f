"""Suffix-array dedup: bytes of repeated 50-byte strings go from every document but the one with the smallest id.

Equal strings are brought together by their minimizer, the least hash of the 20-byte grams inside: every 50-byte string
has one, equal strings have the same. Neighbouring strings of a document with one minimizer form a run. Scans of the texts
do the work, each narrower than the one before:

1. Minimizers met in two or more documents are marked in a bit table: tasks send sorted, difference-coded hashes (about three
   bytes for a run), what two of them hold is shared.
2. Runs of marked minimizers are written as (minimizer, content hash, document, place); an aggregation names the smallest
   and the largest document of each content. A document with a larger id than the smallest loses the whole run.
3. The contents of minimizers that have several are cut out where they stand in their own smallest document, dealt over shards,
   and each shard is sorted by external induced sorting (`suffixes`): suffixes whose common prefix reaches 50 bytes are equal
   strings, and the smallest document of each group tells which strings of a content's own smallest document stand in a still
   smaller one. Whole minimizers are sorted in one task, so this is for those of at most MOST contents. The strings of a more
   common minimizer are told one by one instead: written like the runs of scan 2, each with its own hash, and aggregated.

Only runs that may lose something, and only texts that do, take part in a join; bit tables of fixed size tell which. They only
spare work: what they let through in error removes nothing. At sizes where they fill up everything passes, and results stay the
same. Contents are told apart by 128 bits of hash.

Null text is empty; texts under 50 bytes lose nothing. Rows with equal ids don't remove anything from each other, and a
null id is larger than any other. Repeated rows get equal results, other columns are ignored, an empty table gives no rows. Short
texts are hashed together, a long one piece by piece, with the overlap that its strings need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import split_by
from tidegauge.llm.suffixes import suffix_array
from tidegauge.session import materialise

#: Bytes of a repeated string, of the grams inside, and most strings of a run (bits of a mask).
LENGTH, GRAM, RUN = 50, 20, 64
#: Bytes of text worked on at a time; bytes that a shard gathers before it sorts.
SEGMENT, SHARD = 1 << 16, 1 << 22
#: Bits of a hash that is counted and of the place in a table (so many bits it has), and hashes that a task sorts at a time.
COUNTED, TABLE, SORTED = 40, 27, 1 << 21
#: Most contents of a minimizer that are sorted together: under 4 MB, as a content has at most RUN + LENGTH - 1 bytes.
MOST = 1 << 15
_SPAN = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(7).integers(0, 1 << 64, size=256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray, gap: int, size: int) -> np.ndarray:
    """Polynomial hashes of neighbouring pieces: the right one starts `gap` later and has `size` bytes."""
    n = len(left) - gap
    return left[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + right[gap : gap + n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    one = _CODES[data]
    two = _joined(one, one, 1, 1)
    four = _joined(two, two, 2, 2)
    eight = _joined(four, four, 4, 4)
    sixteen = _joined(eight, eight, 8, 8)
    n = len(data) - GRAM + 1
    return _mixed(sixteen[:n] * np.uint64(pow(_BASE, 4, 1 << 64)) + four[16 : 16 + n])


@dataclass
class Runs:
    """Runs of strings of some texts: minimizer, content hash, text (index to ids and hashes), first and end string, place in data."""

    key: np.ndarray
    content: np.ndarray
    row: np.ndarray
    first: np.ndarray
    end: np.ndarray
    at: np.ndarray
    data: bytes
    ids: np.ndarray
    hashes: np.ndarray

    def columns(self, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """h, content, d, text_hash, place (64 times the first string, and the further ones)."""
        place = self.first[some] * RUN + (self.end[some] - self.first[some] - 1)
        return self.key[some], self.content[some], self.ids[self.row[some]], self.hashes[self.row[some]], place

    def pieces(self, some: np.ndarray) -> np.ndarray:
        cut = np.empty(len(some), dtype=object)
        size = self.end - self.first + LENGTH - 1
        cut[:] = [self.data[a : a + n] for a, n in zip(self.at[some].tolist(), size[some].tolist())]
        return cut


def runs(pieces: list[tuple[int, int, bytes]], ids: np.ndarray, hashes: np.ndarray, alone: Bits | None = None) -> Runs:
    """The runs of pieces of texts: (text, where the piece begins in it, bytes), each of LENGTH bytes or more.

    Minimizers held by `alone` have runs of one string only.
    """
    data = b"".join(p for _, _, p in pieces)
    size = np.array([len(p) for _, _, p in pieces])
    start = np.cumsum(size) - size
    g = gram_hashes(np.frombuffer(data, np.uint8))
    m = g
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[: len(g) - _SPAN + 1], m[_SPAN - 16 :])
    # Strings that lie within one piece.
    many = size - LENGTH + 1
    inside = np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)
    m = m[inside]
    head = np.r_[True, m[1:] != m[:-1]]
    head[np.cumsum(many)[:-1]] = True
    first = np.flatnonzero(head)
    end = np.r_[first[1:], len(m)]
    most = np.where(alone.held(m[first].view(np.int64)), 1, RUN) if alone else np.full(len(first), RUN)
    parts = -(-(end - first) // most)
    if (parts > 1).any():
        nth, most = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts), np.repeat(most, parts)
        end = np.minimum(np.repeat(end, parts), np.repeat(first, parts) + (nth + 1) * most)
        first = np.repeat(first, parts) + nth * most
    key, at, n = m[first], inside[first], end - first
    content = n.astype(np.uint64)
    for step in range(0, RUN + LENGTH, GRAM):
        content = _mixed(content * np.uint64(_BASE) + g[np.minimum(at + step, at + n + LENGTH - 1 - GRAM)])
    piece = np.searchsorted(start, at, "right") - 1
    offset = np.array([o for _, o, _ in pieces], dtype=np.int64)
    first = at - start[piece] + offset[piece]
    row = np.array([r for r, _, _ in pieces])[piece]
    return Runs(key.view(np.int64), content.view(np.int64), row, first, first + n, at, data, ids, hashes)


def scanned(frames: Iterator[pd.DataFrame], alone: Bits | None = None) -> Iterator[Runs]:
    """The runs of all texts (d, text_hash, text), some SEGMENT bytes at a time."""
    for frame in frames:
        ids, hashes = frame["d"].to_numpy(), frame["text_hash"].to_numpy()
        held, size = [], 0
        for row, text in enumerate(frame["text"]):
            data = text.encode()
            for low in range(0, len(data) - LENGTH + 1, SEGMENT):
                piece = data[low : low + SEGMENT + LENGTH - 1]
                if held and size + len(piece) > SEGMENT:
                    yield runs(held, ids, hashes, alone)
                    held, size = [], 0
                held.append((row, low, piece))
                size += len(piece)
        if held:
            yield runs(held, ids, hashes, alone)


class Bits:
    """A bit table of fixed size: `held` is true for every key that was put in, and for few others."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def held(self, keys: np.ndarray) -> np.ndarray:
        at = _mixed(keys.view(np.uint64)) >> np.uint64(64 - TABLE)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key of two."""
    return (_mixed(a.view(np.uint64)) * np.uint64(_BASE) ^ b.view(np.uint64)).view(np.int64)


def _coded(keys: list[np.ndarray], parts: int) -> pd.DataFrame:
    """Sorted hashes of keys, a blob of differences for each part of the table: rows (part, wide, blob)."""
    some = np.sort(_mixed(np.concatenate(keys).view(np.uint64)) >> np.uint64(64 - COUNTED))
    bounds = np.searchsorted(some, np.arange(parts + 1, dtype=np.uint64) << np.uint64(COUNTED - parts.bit_length() + 1))
    rows = []
    for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if a < b:
            step = np.diff(some[a:b], prepend=np.uint64(part) << np.uint64(COUNTED - parts.bit_length() + 1))
            wide = next(w for w in (1, 2, 3, 4, 8) if int(step.max()) < 1 << (8 * w))
            rows.append((part, wide, step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()))
    return pd.DataFrame(rows, columns=["part", "wide", "blob"])


def _decoded(part: int, wide: int, blob: bytes, parts: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, wide)
    step = np.zeros((len(raw), 8), dtype=np.uint8)
    step[:, :wide] = raw
    return np.cumsum(step.view("<u8").ravel()) + (np.uint64(part) << np.uint64(COUNTED - parts.bit_length() + 1))


def tables(df: DataFrame, keys_of: Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]], least: tuple[int, ...]) -> list:
    """For each number in `least` the broadcast table of the keys that come so often or more; `keys_of` yields keys of a task's rows.

    Every part of the tables is settled by one task; a part grows with the keys, so there are four for each shuffle partition.
    """
    spark = df.sparkSession
    parts = 1 << max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    bits = TABLE - parts.bit_length() + 1

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for keys in keys_of(frames):
            held.append(keys)
            n += len(keys)
            if n >= SORTED:
                yield _coded(held, parts)
                held, n = [], 0
        if n:
            yield _coded(held, parts)

    def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = -1, []

        def table() -> pd.DataFrame:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            out = []
            for k, few in enumerate(least):
                at = (value[n >= few] >> np.uint64(COUNTED - TABLE)).astype(np.int64) - (part << bits)
                flags = np.zeros(1 << bits, dtype=np.uint8)
                flags[at] = 1
                if len(at):
                    out.append((part, k, np.packbits(flags, bitorder="little").tobytes()))
            return pd.DataFrame(out, columns=["part", "k", "bits"])

        for frame in frames:
            for p, wide, blob in zip(frame["part"], frame["wide"], frame["blob"]):
                if p != part and held:
                    yield table()
                    held = []
                part = p
                held.append(_decoded(p, wide, blob, parts))
        if held:
            yield table()

    coded = df.mapInPandas(sent, "part int, wide int, blob binary").repartition("part").sortWithinPartitions("part")
    out = [np.zeros(1 << (TABLE - 3), dtype=np.uint8) for _ in least]
    for row in coded.mapInPandas(settled, "part int, k int, bits binary").toArrow().to_pylist():
        size = len(row["bits"])
        out[row["k"]][row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return [spark.sparkContext.broadcast(t) for t in out]


_ROWS = "h long, content long, d long, text_hash long, place long"


def _rows(docs: DataFrame, chosen: Callable[[Runs], np.ndarray], alone=None) -> DataFrame:
    """_ROWS of the runs that `chosen` names."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in scanned(frames, Bits(alone.value) if alone else None):
            some = chosen(r)
            if len(some):
                yield pd.DataFrame(dict(zip(("h", "content", "d", "text_hash", "place"), r.columns(some))))

    return docs.mapInPandas(scan, _ROWS)


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def smaller_elsewhere(contents: list[bytes], lows: np.ndarray) -> np.ndarray:
    """For each content the strings (bits by offset) that another content of a smaller document holds."""
    sizes = np.array([len(c) for c in contents])
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\0".join(contents) + b"\0\0", np.uint8).astype(np.uint16) + 2
    joined[starts + sizes], joined[-1] = 1, 0
    places, common = suffix_array(joined, 258, LENGTH)
    owner = np.repeat(np.arange(len(contents)), np.r_[sizes[:-1] + 1, sizes[-1] + 2])[places]
    offset = places - starts[owner]
    whole = offset <= sizes[owner] - LENGTH
    group = np.cumsum(common < LENGTH)[whole]
    owner, offset = owner[whole], offset[whole]
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(lows[owner], heads), np.diff(np.r_[heads, len(group)]))
    smaller = least < lows[owner]
    masks = np.zeros(len(contents), dtype=np.uint64)
    np.bitwise_or.at(masks, owner[smaller], np.uint64(1) << offset[smaller].astype(np.uint64))
    return masks


def _sorted_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Masks of contents; rows arrive sorted by minimizer and content, and whole minimizers are sorted together.

    A minimizer whose contents all belong to one document removes nothing and isn't sorted.
    """
    contents: list[tuple[int, int, bytes]] = []
    lows: list[int] = []
    first = size = 0  # where the present minimizer begins, bytes before it

    def settle() -> pd.DataFrame:
        masks = smaller_elsewhere([c for _, _, c in contents[:first]], np.array(lows[:first], dtype=np.int64))
        some = np.flatnonzero(masks)
        return pd.DataFrame({"h": [contents[i][0] for i in some], "content": [contents[i][1] for i in some], "mask": masks[some].view(np.int64)})

    def closed() -> None:
        """The present minimizer is whole."""
        nonlocal first, size
        if min(lows[first:]) == max(lows[first:]):
            del contents[first:], lows[first:]
        size += sum(len(c) for _, _, c in contents[first:])
        first = len(contents)

    for frame in frames:
        for key, content, d, data in zip(frame["h"], frame["content"], frame["d"], frame["data"]):
            if len(contents) > first:
                if contents[-1][:2] == (key, content):
                    lows[-1] = min(lows[-1], d)
                    continue
                if contents[-1][0] != key:
                    closed()
            if size >= SHARD and len(contents) == first:
                yield settle()
                contents, lows, first, size = [], [], 0, 0
            contents.append((key, content, bytes(data)))
            lows.append(d)
    if len(contents) > first:
        closed()
    if contents:
        yield settle()


def _lost(rows: DataFrame, contents: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """(d, text_hash, span) of the runs that lose anything; contents: h, content, low, high."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for f in frames:
            yield both(f["h"].to_numpy(), f["content"].to_numpy())

    told = contents.where("low < high").select("h", "content")
    (hit,) = tables(told.unionByName(masks.select("h", "content")) if masks else told, keys, (1,))

    @F.pandas_udf("boolean")
    def concerned(h: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(Bits(hit.value).held(both(h.to_numpy(), content.to_numpy())))

    known = contents.where(concerned("h", "content")).select("h", "content", "low")
    known = known.join(masks, ["h", "content"], "left") if masks else known.withColumn("mask", F.lit(0).cast("long"))
    mask = F.when(F.col("d") > F.col("low"), F.lit(-1)).otherwise(F.coalesce("mask", F.lit(0))).cast("long")
    first = F.floor(F.col("place") / RUN).cast("long")
    span = F.struct(first.alias("first"), (first + F.pmod("place", F.lit(RUN)) + 1).alias("end"), mask.alias("mask")).alias("span")
    return rows.where(concerned("h", "content")).join(known, ["h", "content"]).select("d", "text_hash", span).where("span.mask != 0")


def covered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(d, text_hash, spans): runs of removed strings as (first, end, mask); mask -1 is the whole run."""
    docs = _documents(df, id_col, text_col).select("d", "text_hash", "text").where(F.octet_length("text") >= LENGTH)

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for r in scanned(frames):
            # Once for each text of the block.
            by = np.lexsort((r.key, r.row))
            key, row = r.key[by], r.row[by]
            yield key[np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]]

    (shared,) = tables(docs, met, (2,))
    rows = materialise(_rows(docs, lambda r: np.flatnonzero(Bits(shared.value).held(r.key))), "runs")
    contents = materialise(rows.groupBy("h", "content").agg(F.min("d").alias("low"), F.max("d").alias("high")), "contents")

    def minimizers(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for f in frames:
            yield f["h"].to_numpy()

    def smallest(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for f in frames:
            f = f[Bits(several.value).held(f["h"].to_numpy())]
            yield both(f["content"].to_numpy(), f["low"].to_numpy())

    several, hot = tables(contents.select("h"), minimizers, (2, most + 1))
    (lowest,) = tables(contents.select("h", "content", "low"), smallest, (1,))

    def cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in scanned(frames):
            k = Bits(shared.value).held(r.key) & Bits(several.value).held(r.key) & ~Bits(hot.value).held(r.key)
            k = np.flatnonzero(k & Bits(lowest.value).held(both(r.content, r.ids[r.row])))
            if len(k):
                yield pd.DataFrame({"h": r.key[k], "content": r.content[k], "d": r.ids[r.row[k]], "data": r.pieces(k)})

    pieces = docs.mapInPandas(cut_out, "h long, content long, d long, data binary")
    masks = pieces.repartition("h").sortWithinPartitions("h", "content").mapInPandas(_sorted_shards, "h long, content long, mask long")
    hit = _lost(rows, contents, materialise(masks, "masks"))
    if hot.value.any():
        strings = materialise(_rows(docs, lambda r: np.flatnonzero(Bits(hot.value).held(r.key)), hot), "strings")
        alike = materialise(strings.groupBy("h", "content").agg(F.min("d").alias("low"), F.max("d").alias("high")), "alike")
        hit = hit.unionByName(_lost(strings, alike))
    return hit.groupBy("d", "text_hash").agg(F.collect_set("span").alias("spans"))


def _cover(n: int, spans) -> np.ndarray:
    """True for every byte that goes."""
    step = np.zeros(n + 1, dtype=np.int64)
    for s in spans if spans is not None else ():
        if s["mask"] == -1:
            starts = [(s["first"], s["end"] + LENGTH - 1)]
        else:
            bits = s["mask"] & ((1 << 64) - 1)
            starts = [(s["first"] + o, s["first"] + o + LENGTH) for o in range(RUN) if bits >> o & 1]
        for a, b in starts:
            step[a] += 1
            step[b] -= 1
    return np.cumsum(step[:-1]) > 0


def removed(text: Column, spans: Column) -> Column:
    """struct<n_bytes, n_removed, n_spans, kept, kept_sha256>; kept is binary, as cuts may split characters."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans):
            data = (t or "").encode()
            gone = _cover(len(data), s)
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return cut(text, spans)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and their digest."""
    spans = materialise(covered(df, id_col, text_col, most), "spans")
    some, rest = split_by(_documents(df, id_col, text_col), [F.col("d"), F.col("text_hash")], spans, ["d", "text_hash"])
    cut = some.join(spans, ["d", "text_hash"], "left").select("doc_id", removed(F.col("text"), F.col("spans")).alias("r")).select("doc_id", "r.*")
    data, none = F.col("text").cast("binary"), F.lit(0).cast("long")
    whole = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), data.alias("kept"), F.sha2(data, 256).alias("kept_sha256"))
    return cut.unionByName(whole)
