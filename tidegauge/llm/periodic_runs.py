"""Periodic runs of words: the branching-tandem test on an enhanced suffix array.

Words become numbers, suffixes are sorted by prefix doubling, and the common prefixes of neighbours are read off the ranks
of the doubling rounds. A square of period D whose right end can't be shifted is a pair of suffixes i and i + D in two
children of an LCP interval of depth D. So for every interval the suffixes of all children but the largest are tested:
is i + D, or i - D, in the interval (its rank within the bounds), and does the next word differ? That is n log n tests and
needs the arrays only, no tree nodes. Squares found that way are rotated to the left as long as the words agree, which
gives the whole run; of squares that end at the same word the smallest period stands for its multiples.

A run is a stretch whose smallest period is q, that no neighbour extends, of at least max(12, 2 q) words. Its suffixes at
distance q share 6 words or more, so only texts with such a common prefix get as far as the interval test.

Documents are worked on in blocks of about BLOCK words, one suffix array for each block, in which texts cannot match each
other since numbers of words are their own. A text longer than that is a block of its own; it is never cut. Null or blank text
has no words and no run; a null id is never rebuilt. Repeated rows get equal results, other columns are ignored, an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run, words that two suffixes of such a run share at least, words sorted together.
LEAST, SHARED, BLOCK = 12, 6, 200_000
#: Left shifts of squares that are made all together, one word at a time, before the long ones go stretch by stretch.
STEPS = 48


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the words that each shares with the one before; every text must end in a number of its own."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    # A suffix's rank is the first place of its group; groups of one are settled.
    head = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
    group = np.repeat(head, np.diff(np.r_[head, n]))
    rank[order] = group
    levels, parted = [rank.astype(np.int32)], np.full(n, -1, dtype=np.int8)
    parted[head] = 0
    sizes = np.diff(np.r_[head, n])
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 1
    while len(open_):
        place = order[open_]
        first = rank[place]
        # What follows an open suffix at h is within its text: its last h words would else be its own.
        key = first * (n + 1) + rank[place + h]
        by = np.argsort(key, kind="stable")
        order[open_] = place[by]
        key = key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        parted[open_[new & (parted[open_] < 0)]] = len(levels)
        head = np.flatnonzero(new)
        sizes = np.diff(np.r_[head, len(key)])
        rank[order[open_]] = np.repeat(open_[head], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        levels.append(rank.astype(np.int32))
        h *= 2
    return order, _common(order, levels, parted)


def _common(order: np.ndarray, levels: Sequence[np.ndarray], parted: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours, from the ranks by 1, 2, 4, ... words, the largest step first."""
    common = np.zeros(len(order), dtype=np.int64)
    at = np.flatnonzero(parted > 0)
    left, right = order[at - 1].copy(), order[at].copy()
    for k in range(len(levels) - 2, -1, -1):
        some = np.flatnonzero(parted[at] > k)
        same = some[levels[k][left[some]] == levels[k][right[some]]]
        left[same] += 1 << k
        right[same] += 1 << k
        common[at[same]] += 1 << k
    return common


def child_intervals(common: Sequence[int], base: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(depth, first, end, child's first, child's end) of all children but a largest one; places count from `base`.

    `common[0]` belongs to the neighbour before and is not looked at.
    """
    stack: list[tuple[int, int, list[int]]] = []  # depth, first place, where children begin

    def closed(depth: int, first: int, starts: list[int], end: int):
        bounds = [*starts, end]
        widths = [b - a for a, b in zip(bounds, bounds[1:])]
        largest = widths.index(max(widths))
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if k != largest:
                yield depth, base + first, base + end, base + a, base + b

    for place in range(1, len(common) + 1):
        depth = common[place] if place < len(common) else 0
        first = place - 1
        while stack and stack[-1][0] > depth:
            d, first, starts = stack.pop()
            yield from closed(d, first, starts, place)
        if not depth:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(place)
        else:
            stack.append((depth, first, [first, place]))


def branching_squares(symbols: np.ndarray, order: np.ndarray, where: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cannot be shifted right; children: rows of `child_intervals`."""
    starts, periods = [], []
    widths = children[:, 4] - children[:, 3]
    reach = np.cumsum(widths)
    low, n = 0, len(symbols)
    while low < len(children):
        high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + (1 << 20), "right")))
        some, wide = children[low:high], widths[low:high]
        at = np.repeat(some[:, 3], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        depth, first, end = (np.repeat(some[:, k], wide) for k in range(3))
        for square in (order[at], order[at] - depth):
            other = np.where(square == order[at], square + depth, square)
            held = (other >= 0) & (other < n)
            held[held] &= (where[other[held]] >= first[held]) & (where[other[held]] < end[held])
            s, d = square[held], depth[held]
            branching = symbols[s + d] != symbols[s + 2 * d]
            starts.append(s[branching])
            periods.append(d[branching])
        low = high
    return np.concatenate(starts), np.concatenate(periods)


def _shift(symbols: np.ndarray, start: int, period: int) -> int:
    """How far a square can be rotated to the left, stretch by stretch."""
    done, size = 0, 64
    while start - done > 0:
        size = min(size * 2, start - done)
        a = symbols[start - done - size : start - done]
        differ = np.flatnonzero(a != symbols[start - done - size + period : start - done + period])
        if len(differ):
            return done + size - 1 - int(differ[-1])
        done += size
    return done


def merged(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs that the squares belong to."""
    end = start + 2 * period
    by = np.lexsort((period, end))
    start, period, end = start[by], period[by], end[by]
    out = []
    while len(start):
        # The smallest period of each end; longer ones that lie within its run are multiples of it.
        head = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        s, p = start[head].copy(), period[head]
        moving = np.arange(len(s))
        for _ in range(STEPS):
            moving = moving[s[moving] > 0]
            moving = moving[symbols[s[moving] - 1] == symbols[s[moving] - 1 + p[moving]]]
            if not len(moving):
                break
            s[moving] -= 1
        for k in moving:
            s[k] -= _shift(symbols, int(s[k]), int(p[k]))
        out.append(np.stack([s, end[head], p], axis=1))
        whole = np.repeat(end[head] - s, np.diff(np.r_[head, len(end)]))
        left = 2 * period > whole
        start, period, end = start[left], period[left], end[left]
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), dtype=np.int64)


def runs_of(texts: Sequence[Sequence[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text the runs as (start, length, period), by start, then period."""
    ids: dict = {}
    number = count()
    symbols, starts = [], [0]
    for words in texts:
        ids.clear()
        symbols.extend([ids[w] if w in ids else ids.setdefault(w, next(number)) for w in words])
        symbols.append(next(number))  # the end of a text equals nothing
        starts.append(len(symbols))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(symbols) <= len(texts):
        return out
    symbols = np.array(symbols, dtype=np.int64)
    order, common = suffix_ranks(symbols)
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.arange(len(order))
    bounds = np.array(starts)
    # Numbers grow from text to text, but words share one order: a text's suffixes lie together, as its numbers do.
    long_ = np.unique(np.searchsorted(bounds, order[np.flatnonzero(common >= SHARED)], "right") - 1)
    if not len(long_):
        return out
    children: list[tuple[int, int, int, int, int]] = []
    for text in long_.tolist():
        low, high = starts[text], starts[text + 1]
        children.extend(child_intervals(common[low:high].tolist(), low))
    start, period = branching_squares(symbols, order, where, np.array(children, dtype=np.int64))
    runs = merged(symbols, start, period)
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST]
    text = np.searchsorted(bounds, runs[:, 0], "right") - 1
    for k, (a, b, p) in zip(text.tolist(), runs.tolist()):
        out[k].append((a - starts[k], b - a, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The words, made periodic from some place on in a tenth of the documents (h: CRC-32 of the id)."""
    n = len(words)
    if h is None or h != h or int(h) % 10 or not n:
        return words
    g = int(h) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    keep = words
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, p in runs:
            gone[s + p] += 1
            gone[s + n] -= 1
        keep = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return len(runs), *best, 1000 * best[1] // best[2] if runs else None, listed, b" ".join(keep)


FIELDS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def found(text: Column, h: Column, digests: bool = True) -> Column:
    """struct of FIELDS; `h` says which texts are rebuilt (null: none). Without `digests` the lists and texts themselves."""
    names = [c if digests else c.removesuffix("_sha256") for c in FIELDS]

    @F.pandas_udf(", ".join(f"{a} {b}" for a, b in zip(names, FIELDS.values())))
    def scan(texts: pd.Series, hs: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        held: list[list[bytes]] = []
        size = 0

        def settle() -> None:
            for words, runs in zip(held, runs_of(held)):
                *told, listed, kept = _row(words, runs)
                rows.append((*told, *((hashlib.sha256(x).hexdigest() for x in (listed.encode(), kept)) if digests else (listed, kept.decode()))))

        for t, h in zip(texts, hs):
            words = planted(words_of(t), h)
            if held and size + len(words) > BLOCK:
                settle()
                held, size = [], 0
            held.append(words)
            size += len(words) + 1
        settle()
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in names[:5]})

    return scan(text, h)


def find_runs(df: DataFrame, rebuild: bool = False, digests: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the periodic runs of each text: how many, the longest, and digests of all and of the text without repeats.

    With `rebuild`, a tenth of the documents, told by their ids, are made periodic first.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary")) if rebuild else F.lit(None).cast("long")
    return df.select(F.col(id_col).alias("doc_id"), found(F.col(text_col), h, digests).alias("r")).select("doc_id", "r.*")
