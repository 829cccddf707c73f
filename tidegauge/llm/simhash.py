"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: lower-case words, their shingles (repeats included), XXH64 of each with seed 42; a bit of the fingerprint is
one if it is set in over half of the hashes. Equal fingerprints are one row from then on, so copies cost nothing more.

Two fingerprints within `radius` bits agree on all bits of at least `agree` of `radius + agree` blocks (pigeonhole), so
those that share the blocks of some choice are compared, and no link is lost. A run of fingerprints with the same key is
compared bit-sliced: bit planes are stored vertically, 64 fingerprints a word; for a query each plane is flipped by the
query's bit, carry-save adders count the differing bits of all 64 lanes at once, and words are abandoned as soon as all
their lanes exceed the radius. Runs longer than `RUN` are dealt into chunks, and pairs of chunks are compared in tasks of
their own, so no task holds an unbounded run.

A run passes on only the links to the smallest member of each of its groups; the groups of all runs are then joined by
alternating star contraction over written tables until nothing changes.

Null text and text without words have fingerprint zero, linked like any other. Rows with null ids are linked too; a
component is named by its smallest non-null id (null if it has none). Texts of any length are read whole, COUNTED shingles at a
time; repeated rows are members like others, `one_of_each` keeps one of them. Other columns are ignored by `grouped` and
`near_copies` and passed on by `one_of_each`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, split_by
from tidegauge.session import materialise

SEED, BITS = 42, 64
#: Longest run of fingerprints that one task compares whole; and words of 64 lanes that are compared at a time.
RUN, SLICE = 4096, 1 << 15
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOW = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)
_ONE = np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned 64 bits."""
    w = words(text)
    if not w:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(w) < width:
        return hashed(b" ".join(w), SEED)
    counts, n = np.zeros(BITS, dtype=np.int64), len(w) - width + 1
    for low in range(0, n, COUNTED):
        some = w[low : low + COUNTED + width - 1]
        h = np.array([hashed(b" ".join(s), SEED) for s in zip(*(some[i:] for i in range(width)))], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """[bits, words]: bit b of lane l of word w is bit b of fingerprint 64 w + l (prints: rows x 64-bit parts)."""
    n = len(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints, dtype="<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-n // 64) * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry bits of three bit vectors."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def near_lanes(prints: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, mask: np.ndarray, radius: int):
    """(query, word, lanes): for each (query, word) the lanes of `mask` within the radius; none left, none returned."""
    size = max(2, radius.bit_length())
    start = (1 << size) - 1 - radius  # counters overflow just beyond the radius
    count = [np.full(len(query), _LOW[64] if start >> k & 1 else 0, dtype=np.uint64) for k in range(size)]
    alive = mask.copy()
    for b in range(0, len(planes), 4):
        bits = prints[query, b // BITS]
        x = [planes[b + k][word] ^ (np.uint64(0) - ((bits >> np.uint64((b + k) % BITS)) & _ONE)) for k in range(4)]
        count[0], two = _add(count[0], x[0], x[1])
        count[0], more = _add(count[0], x[2], x[3])
        count[1], carry = _add(count[1], two, more)
        for k in range(2, size):
            count[k], carry = count[k] ^ carry, count[k] & carry
        alive &= ~carry
        if b % 8 == 4:
            left = alive != 0
            if np.count_nonzero(left) < 0.8 * len(left):
                query, word, alive, count = query[left], word[left], alive[left], [c[left] for c in count]
                if not len(query):
                    break
    left = alive != 0
    return query[left], word[left], alive[left]


def roots(prints: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first of its group (rows sorted by group) that links of `radius` bits lead to."""
    n = len(prints)
    label = np.arange(n)
    end = np.searchsorted(group, group, "right")
    query = np.flatnonzero(end - np.arange(n) > 1)
    if not len(query):
        return label
    planes = bit_planes(prints)
    first, last = (query + 1) // 64, (end[query] - 1) // 64
    reach = np.cumsum(last - first + 1)
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + SLICE, "right")))
        q = np.repeat(query[at:to], (last - first + 1)[at:to])
        w = np.arange(len(q)) - np.repeat(np.r_[0, np.cumsum((last - first + 1)[at:to])[:-1]], (last - first + 1)[at:to]) + np.repeat(first[at:to], (last - first + 1)[at:to])
        mask = _LOW[np.clip(end[q] - 64 * w, 0, 64)] & ~_LOW[np.clip(q + 1 - 64 * w, 0, 64)]
        q, w, lanes = near_lanes(prints, planes, q, w, mask, radius)
        if len(q):
            row, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            _join(label, q[row], w[row] * 64 + lane)
        at = to
    return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the groups of a and b; labels are smallest members."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def keys(fp: Column, radius: int, agree: int) -> Column:
    """array<long>: one key for each choice of `agree` blocks out of `radius + agree` of a 64-bit fingerprint."""
    blocks, bounds = radius + agree, [BITS * i // (radius + agree) for i in range(radius + agree + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        parts = [F.shiftrightunsigned(fp, bounds[b]).bitwiseAND(F.lit((1 << (bounds[b + 1] - bounds[b])) - 1)) for b in chosen]
        out.append(F.xxhash64(F.lit(n), *parts))
    return F.array(*out)


def _compared(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links to the first of each group within runs; rows arrive sorted by run, which may go on in the next frame."""
    rest: pd.DataFrame | None = None

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        run = rows[["key", "i", "j"]].to_numpy()
        prints = np.stack(rows["fp"].to_list()).astype(np.int64).view(np.uint64)
        label = roots(prints, np.r_[0, np.cumsum(np.any(run[1:] != run[:-1], axis=1))], radius)
        other, v = np.flatnonzero(label != np.arange(len(label))), rows["v"].to_numpy()
        return pd.DataFrame({"a": v[other], "b": v[label[other]]}).drop_duplicates()

    for frame in frames:
        rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(rows):
            continue
        last = rows.iloc[-1]
        open_run = (rows["key"] == last["key"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])
        cut = int(open_run.to_numpy().argmax())
        if cut:
            yield linked(rows.iloc[:cut])
        rest = rows.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield linked(rest)


def links(prints: DataFrame, radius: int, run: int = RUN) -> DataFrame:
    """(a, b): links between fingerprints that connect all that share a key and are within the radius of each other.

    `prints` has one row per fingerprint: v (its number), fp (array of 64-bit parts), keys.
    """
    rows = prints.select("v", "fp", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # Fingerprints alone under a key have nothing to compare with; long runs are dealt into chunks, chunk pairs compared.
    chunks = F.ceil(F.col("n") / F.lit(run // 2)).cast("int")
    rows = rows.join(sizes, "key").withColumn("m", F.when(F.col("n") > run, chunks).otherwise(1))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("v", F.lit(7)), "m").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    rows = rows.select("key", "v", "fp", "c", other.alias("o")).select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "v", "fp")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "v")
    return dealt.mapInPandas(lambda frames: _compared(frames, radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every linked vertex but the smallest of its component, and that smallest; alternating stars until stable."""

    def smallest(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low.select("u", F.least("u", "m").alias("m")), "u")

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        return smallest(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        s = smallest(down)
        stars = s.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(s.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return stars.where("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialise(edges.where("a != b").distinct(), "links")
    was = None
    while (is_now := state(now)) != was:
        was = is_now
        now = materialise(small(materialise(large(now).distinct(), "large")), "small")
    return now


def roots_of(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """v, low, root: the smallest number of each one's component by the links `edges`; prints: v, low."""
    stars = components(edges).select(F.col("a").alias("v"), F.col("b").alias("root"))
    return prints.select("v", "low").join(stars, "v", "left").select("v", "low", F.coalesce("root", "v").alias("root"))


def _named(docs: DataFrame, prints: DataFrame, edges: DataFrame) -> DataFrame:
    """`docs` (with v) and the smallest doc_id of each one's component."""
    rooted = roots_of(prints, edges)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return docs.join(rooted.join(lowest, "root").select("v", "component_id"), "v")


def grouped(df: DataFrame, width: int, radius: int, agree: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, v (the fingerprint), component_id: the smallest id that links of at most `radius` differing bits lead to."""
    docs = materialise(df.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), width).alias("v")), "prints")
    prints = docs.groupBy("v").agg(F.min("doc_id").alias("low")).withColumn("fp", F.array("v")).withColumn("keys", keys(F.col("v"), radius, agree))
    return _named(docs, prints, links(prints, radius))


#: Near copies by similarity: 256-bit fingerprints; those that share one of 16 bands of 4 MinHash values are compared.
PARTS, BANDS, ROWS = 4, 16, 4
#: Texts, and shingles of theirs, from which on the texts of a group of candidates are dealt into chunks.
GROUP, GROUP_SHINGLES = 512, 1 << 20


def radius_for(similarity: float, parts: int = PARTS, errors: float = 4.0) -> int:
    """Differing bits of two shingle sets of this Jaccard similarity: those expected, and `errors` standard errors more."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = BITS * parts
    return int(bits * apart + errors * math.sqrt(bits * apart * (1 - apart)))


_SALTS = np.random.default_rng(SEED).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) | _ONE
_STEPS = np.random.default_rng(SEED + 1).integers(1, 1 << 63, size=PARTS, dtype=np.uint64) | _ONE


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    w = words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    parts, size, digest = [], max(1, len(w) - width + 1), xxhash.xxh3_64_intdigest
    for low in range(0, size, COUNTED):
        some = w[low : low + COUNTED + width - 1] if size > 1 else w
        grams = {b" ".join(s) for s in zip(*(some[i:] for i in range(width)))} if len(w) >= width else [b" ".join(w)]
        parts.append(np.unique(np.array([digest(g, SEED) for g in grams], dtype=np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _mixed(h: np.ndarray) -> np.ndarray:
    """[rows, PARTS]: independent 64-bit parts for every hash (SplitMix64)."""
    z = h[:, None] + _STEPS
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_print(text: str | None, width: int) -> tuple[int, int, list[int], list[int]]:
    """Key and size of the set of shingles, signed parts of its 256-bit fingerprint, and its band keys; repeats don't count."""
    every = shingle_set(text, width)
    if not len(every):
        return 0, 0, [0] * PARTS, [0]
    counts = np.zeros(BITS * PARTS, dtype=np.int64)
    least = np.full(BANDS * ROWS, _LOW[64], dtype=np.uint64)
    for low in range(0, len(every), 4096):
        h = every[low : low + 4096, None]
        counts += np.unpackbits(_mixed(h[:, 0]).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        mixed = h * _SALTS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _SALTS[::-1]).min(axis=0))
    bands = [xxhash.xxh64_intdigest(b, i) for i, b in enumerate(least.reshape(BANDS, ROWS).astype("<u8").view("V%d" % (8 * ROWS)).ravel().tolist())]
    own = np.array([xxhash.xxh64_intdigest(every.astype("<u8").tobytes(), SEED)], dtype=np.uint64).view(np.int64)
    signed = np.packbits(counts * 2 > len(every), bitorder="little").view("<i8")
    return int(own[0]), len(every), signed.tolist(), np.array(bands, dtype=np.uint64).view(np.int64).tolist()


def wide_prints(text: Column, width: int) -> Column:
    """struct<v, size, fp, keys> of `wide_print`."""

    @F.pandas_udf("v long, size long, fp array<long>, keys array<long>")
    def printed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wide_print(t, width) for t in texts], columns=["v", "size", "fp", "keys"])

    return printed(text)


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of distinct numbers the first of its group that links of at least this Jaccard similarity lead to."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    label, last = np.arange(n), np.cumsum(sizes)
    if n < 2:
        return label
    gram = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(label, sizes)[np.argsort(gram, kind="stable")]
    many = np.bincount(gram)
    first = np.cumsum(many) - many
    for i in range(n - 1):
        own = gram[last[i] - sizes[i] : last[i]]
        own = own[many[own] > 1]
        count = many[own]
        at = np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(holders[at], minlength=n)[i + 1 :]
        other = np.flatnonzero(shared / (sizes[i] + sizes[i + 1 :] - shared) >= similarity) + i + 1
        _join(label, np.full(len(other), i), other)
    return label


def _verified(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of similar texts to the first of each group within runs; rows (root, i, j, v, text) arrive sorted by all but the text."""
    run, numbers, sets = None, [], []

    def linked() -> pa.RecordBatch:
        label, v = similar(sets, similarity), np.array(numbers, dtype=np.int64)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(v[other]), pa.array(v[label[other]])], names=["a", "b"])

    for batch in batches:
        keyed = zip(*(batch.column(k).to_pylist() for k in range(4)))
        for (*now, v), text in zip(keyed, batch.column(4)):
            if now != run:
                if len(sets) > 1:
                    yield linked()
                run, numbers, sets = now, [], []
            if not numbers or numbers[-1] != v:
                numbers.append(v)
                sets.append(shingle_set(text.as_py(), width))
    if len(sets) > 1:
        yield linked()


def _against(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of texts to held ones within runs; rows (root, i, j, side, v, text) arrive sorted, those to hold (side 0) first."""
    run, held, sets, a, b = None, [], [], [], []
    index: tuple | None = None

    def linked(v: int, own: np.ndarray) -> None:
        grams, owner, sizes = index
        at = np.searchsorted(grams, own)
        many = np.searchsorted(grams, own, "right") - at
        place = np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(owner[place], minlength=len(sizes))
        for k in np.flatnonzero(shared >= similarity * (sizes + len(own) - shared)).tolist():
            if held[k] != v:
                a.append(v)
                b.append(held[k])

    for batch in batches:
        keyed = zip(*(batch.column(k).to_pylist() for k in range(5)))
        for (*now, side, v), text in zip(keyed, batch.column(5)):
            if now != run:
                run, held, sets, index = now, [], [], None
            own = shingle_set(text.as_py(), width)
            if not side:
                held.append(v)
                sets.append(own)
                continue
            if index is None:
                sizes = np.array([len(x) for x in sets])
                every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                by = np.argsort(every, kind="stable")
                index = every[by], np.repeat(np.arange(len(sets)), sizes)[by], sizes
            linked(v, own)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []


def _met(held: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links between texts and the ones to hold, both dealt to (root, i, j)."""
    rows = held.select("root", "i", "j", F.lit(0).alias("side"), "v", "text").unionByName(texts.select("root", "i", "j", F.lit(1).alias("side"), "v", "text"))
    dealt = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "v")
    return dealt.mapInArrow(lambda batches: _against(batches, width, similarity), "a long, b long").distinct()


def similar_links(
    texts: DataFrame, prints: DataFrame, width: int, similarity: float, group: int = GROUP, shingles: int = GROUP_SHINGLES
) -> DataFrame:
    """(a, b): links that connect all candidates whose sets of shingles have at least this Jaccard similarity, and no others.

    `texts`: doc_id, text_hash, text; `prints`: a row per set with v, size, fp, keys, and one text that has it, as doc_id and
    text_hash. Candidates are the groups that wide fingerprints link; only their texts move. The texts of a group are compared
    with each other in one task. A larger group is first compared with one of its texts: those like it are linked already, and
    only the others have to meet all the rest, chunk by chunk.
    """
    stars = components(links(prints, radius_for(similarity)))
    member = stars.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
    member = materialise(member.join(prints.select("v", "size", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "v"), "candidates")
    chunks = F.greatest(F.ceil(F.greatest(F.count("*") / F.lit(group), F.sum("size") / F.lit(shingles))).cast("int"), F.lit(1))
    rows = member.join(member.groupBy("root").agg(chunks.alias("m"), F.min("v").alias("first")), "root")
    some, _ = split_by(texts, [F.col("doc_id"), F.col("text_hash")], member, ["id", "hash"])
    rows = some.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    # A text that is there twice is one candidate.
    rows = materialise(rows.select("root", "m", "first", "v", "size", "text").dropDuplicates(["v"]), "texts")
    small = rows.where("m = 1").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "v", "text").repartition("root").sortWithinPartitions("root", "v")
    within = small.mapInArrow(lambda batches: _verified(batches, width, similarity), "a long, b long").distinct()
    large = rows.where("m > 1").withColumn("i", F.pmod(F.xxhash64("v", F.lit(7)), "m").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    first = large.where("v = first").withColumn("i", every)
    met = materialise(_met(first.withColumn("j", F.lit(0)), large.where("v != first").withColumn("j", F.lit(0)), width, similarity), "met")
    rest = large.where("v != first").join(met.select(F.col("a").alias("v")).distinct(), "v", "left_anti")
    dealt = rest.groupBy("root").agg(chunks.alias("n"))
    rest = rest.join(dealt, "root").withColumn("j", F.pmod(F.xxhash64("v", F.lit(8)), "n").cast("int")).withColumn("i", every)
    others = large.join(dealt, "root").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return within.unionByName(met).unionByName(_met(rest, others, width, similarity))


def _similar(df: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, text_hash, v), sets of shingles (v, low), and the links between sets."""
    texts = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    docs = materialise(texts.select("doc_id", "text_hash", wide_prints(F.col("text"), width).alias("p")).select("doc_id", "text_hash", "p.*"), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    prints = docs.groupBy("v").agg(least.alias("w"), *[F.min(c).alias(c) for c in ("size", "fp", "keys")])
    prints = prints.select("v", "size", "fp", "keys", "w.doc_id", "w.text_hash", F.col("w.doc_id").alias("low"))
    return docs.select("doc_id", "text_hash", "v"), prints, similar_links(texts, prints, width, similarity)


def near_copies(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, v, component_id: texts whose sets of shingles have a Jaccard similarity of at least `similarity` are linked.

    Fingerprints only propose groups: the radius leaves four standard errors of their estimate (0.05 each), and every link
    is one of the exact sets.
    """
    docs, prints, edges = _similar(df, width, similarity, id_col, text_col)
    return _named(docs.select("doc_id", "v"), prints, edges)


def one_of_each(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one row of each group of near copies: the smallest id, then the smallest hash of the text; nulls last.

    Groups are settled on narrow rows and the texts of candidates. Documents without a copy pass as they are; the others meet
    the verdict by id and text hash, and only winners that are repeated row for row are de-duplicated.
    """

    docs, prints, edges = _similar(df, width, similarity, id_col, text_col)
    member = roots_of(prints, edges)
    same = materialise(docs.groupBy("doc_id", "text_hash", "v").agg(F.count("*").alias("n")).join(member.select("v", "root"), "v"), "same")
    best = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("w"), F.sum("n").alias("total"))
    i, h, n, hash_ = (free_name(df, x) for x in ("__id", "__hash", "__n", "__text_hash"))
    won = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("text_hash") == F.col("w.text_hash"))
    told = same.join(best.where("total > 1"), "root").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.when(won, F.col("n")).otherwise(0).alias(n))
    told = materialise(told, "told")
    some, rest = split_by(df.withColumn(hash_, F.xxhash64(F.col(text_col))), [F.col(id_col), F.col(hash_)], told, [i, h])
    some = some.join(told, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(hash_) == F.col(h)), "left")
    own = some.where(F.col(n).isNull() | (F.col(n) == 1)).select(*df.columns)
    return rest.select(*df.columns).unionByName(own).unionByName(some.where(F.col(n) > 1).dropDuplicates([i, h]).select(*df.columns))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
