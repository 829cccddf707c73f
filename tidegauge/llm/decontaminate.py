"""Benchmark decontamination by size-partitioned MinHash containment search.

An item leaks into a document if at least `containment` of its distinct five-word shingles stand there. Items are
partitioned by size (powers of two of their shingle count). The MinHash sketch of an item is its smallest shingle
hashes, just so many (shingles - required + 1) that a document without any of them cannot hold the required number;
each size class has one hash bound, the largest sketch value in it. A document's sketch for a class are its shingle
hashes up to that bound, and it is only compared with classes of which it has enough shingles. Sharing a sketch value
makes a candidate; no leak can be missed. Candidates are verified by exact shingle containment, on the shingles
themselves.

The test items are a stated query set: they are read in blocks of bounded size, each searched against all documents
where they are stored, so documents are never shuffled and a passage that a third of them quotes costs each only a look-up.

Words are bounded by ASCII white space, A-Z lower-cased. An item of one to four words is one shingle of all its words, which is
looked for among the shingles of so many words of every document, so short questions and answers are found inside long
texts; only the word counts that occur among the items are looked up. A null text or one without words holds nothing and leaks
nowhere. Equal items are told apart by their ids; rows with equal documents each get their matches. Texts of any length are
searched whole; empty tables give empty results; other columns are ignored by `leaks` and passed on by `clean`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import only

#: Words in a shingle and the least share of an item's shingles.
SHINGLE, CONTAINMENT = 5, 0.8
#: UTF-8 bytes of test items that are searched for at once (what is sent to every executor).
BLOCK_BYTES = 4_000_000

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split(b" ") if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit sways every output bit (finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(1 << 16, _FACTOR | np.uint64(1), dtype=np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each blank-separated word of normalised text."""
    b = np.frombuffer(data, np.uint8)
    word = b != 32
    if not word.any():
        return np.zeros(0, np.uint64)
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)])) if start[0] == 0 else None
    if at is None:
        b, start, end = b[start[0] :], start - start[0], end - start[0]
        at = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)]))
    term = (b.astype(np.uint64) + np.uint64(1)) * _mixed(_POWERS[at & 0xFFFF] + (at >> 16).astype(np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(term, dtype=np.uint64)]
    return _mixed(sums[end] - sums[start])


def shingle_hashes(words_of: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all shingles of so many words, in order, from the hashes of the words."""
    if len(words_of) < width:
        return np.zeros(0, np.uint64)
    h = np.full(len(words_of) - width + 1, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        h = _mixed(h * _FACTOR + words_of[j : len(words_of) - width + 1 + j])
    return h


def shingles(text: str | None, width: int = SHINGLE) -> set[bytes]:
    w = [x for x in words(text) if x]
    return {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}


def width_of(text: str | None) -> int:
    """Words in an item's shingles: SHINGLE, or all it has."""
    return min(SHINGLE, sum(map(bool, words(text))))


class ItemBlock:
    """The sketches of some test items, by words in a shingle and size class."""

    def __init__(self, items: list[tuple[int, str]], containment: float):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.widths = [width_of(t) for t in self.texts]
        self.sets, self.need = [shingles(t, w) if w else set() for t, w in zip(self.texts, self.widths)], []
        self.classes: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        by_class: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for i, (text, width) in enumerate(zip(self.texts, self.widths)):
            need = math.ceil(containment * len(self.sets[i]) - 1e-9)
            self.need.append(need)
            if width:
                h = np.unique(shingle_hashes(word_hashes(text.encode().translate(_PLAIN)), width))
                by_class.setdefault((width, len(h).bit_length()), []).append((i, h[: len(h) - min(need, len(h)) + 1]))
        for (width, _), sketches in by_class.items():
            value = np.concatenate([s for _, s in sketches])
            item = np.repeat([i for i, _ in sketches], [len(s) for _, s in sketches])
            order = np.argsort(value, kind="stable")
            self.classes.setdefault(width, []).append((min(self.need[i] for i, _ in sketches), value[order], item[order]))

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles in the text, all its shingles) for the items that leak into the text."""
        if not text:
            return
        held = word_hashes(text.encode().translate(_PLAIN))
        candidates: set[int] = set()
        for width, classes in self.classes.items():
            hashes = shingle_hashes(held, width)
            for least, value, item in classes:
                if len(hashes) < least:
                    continue
                own = hashes[hashes <= value[-1]]
                low, high = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
                hit = high > low
                for a, b in set(zip(low[hit].tolist(), high[hit].tolist())):
                    candidates.update(item[a:b].tolist())
        if candidates:
            own = {w: shingles(text, w) for w in {self.widths[i] for i in candidates}}
            for i in sorted(candidates):
                n = len(self.sets[i] & own[self.widths[i]])
                if n >= self.need[i]:
                    yield i, n, len(self.sets[i])


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The non-null items in blocks of at most `block_bytes` of text (or one item); one partition is in memory at a time."""
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["t"].encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def _found(docs: DataFrame, text: Column, block: list[tuple[int, str]], containment: float, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    key = f"items:{hash(tuple(block))}:{containment}"

    @F.pandas_udf("array<struct<item: int, shared: int, shingles: int>>")
    def found(texts: pd.Series) -> pd.Series:
        own = only(key, lambda: ItemBlock(sent.value, containment))
        return pd.Series([[{"item": i, "shared": n, "shingles": m} for i, n, m in own.matches(t)] for t in texts], dtype=object)

    return docs.withColumn(name, found(text))


def leaks(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for every document and item that leaks into it."""
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        ids = F.array(*[F.lit(i).cast(kind) for i, _ in block]) if len(block) <= 256 else None
        part = _found(rows, F.col("text"), block, containment, "m").select("doc_id", F.explode("m").alias("m"))
        if ids is None:  # the block's ids as a table: as bounded as the block
            table = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id " + kind.simpleString())
            part = part.join(F.broadcast(table), F.col("m.item") == table["item"])
        else:
            part = part.withColumn("item_id", F.get(ids, F.col("m.item")))
        parts.append(part.select("doc_id", "item_id", F.col("m.shared").cast("long").alias("n_shared"), F.col("m.shingles").cast("long").alias("n_shingles")))
    if not parts:
        parts = [rows.limit(0).select("doc_id", F.lit(None).cast(kind).alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_shingles"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents into which no item leaks, with all their columns; rows are judged one by one."""
    columns = docs.columns
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        name = "__leaks"
        while name in docs.columns:
            name += "_"
        docs = _found(docs, F.col(text_col), block, containment, name).where(F.size(name) == 0).select(*columns)
    return docs
