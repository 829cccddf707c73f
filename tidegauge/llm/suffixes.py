"""Suffix arrays with common-prefix values by external induced sorting, for one shard inside one task.

A suffix is of type S if it is smaller than its right neighbour, else L; an S after an L is a seed (LMS). Sorted seeds
induce everything else: L suffixes come out of a priority queue in ascending order, each popped suffix pushing its left
neighbour if that is L; then S suffixes in descending order in the same way. The queue's key is the first symbol, ties
leave in the order they came, so it is a row of first-in-first-out buckets. Buckets are batches of numbers that go to a
scratch file once more than `memory` of them are held, and come back as the sweep reaches them. Every entry carries the
common prefix with its predecessor in its bucket: one more than the least value popped since that predecessor was pushed.

The seeds themselves are sorted by a first induction over the seed substrings, which get names by rank; if names repeat,
the shorter string of names is sorted in turn, by rank doubling, as far as `depth` symbols of the text reach. So order
and common prefixes are exact up to `depth`, and values are capped there.

Scratch files belong to the task alone, hold nothing that any other task reads, and vanish when they are closed.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Numbers that the queues of a task hold in memory.
MEMORY = 1 << 23


class BucketQueue:
    """A priority queue over symbols, first in first out within a symbol; long queues live in a scratch file."""

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.batches: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbol: int, places: np.ndarray, common: np.ndarray) -> None:
        batch = np.stack([places, common])
        if self.held + batch.size > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.batches[symbol].append((self.file.tell(), batch.shape[1]))
            self.file.write(batch.tobytes())
            return
        self.held += batch.size
        self.batches[symbol].append(batch)

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of the symbol's entries in the order they came, those pushed meanwhile included."""
        queue = self.batches[symbol]
        while queue:
            taken, n, size = [], 0, 0
            while n < len(queue) and size < self.memory:
                batch = queue[n]
                if isinstance(batch, tuple):
                    self.file.seek(batch[0])
                    batch = np.frombuffer(self.file.read(batch[1] * 16), dtype=np.int64).reshape(2, -1)
                else:
                    self.held -= batch.size
                taken.append(batch)
                n, size = n + 1, size + batch.size
            del queue[:n]
            whole = np.concatenate(taken, axis=1)
            yield whole[0], whole[1]

    def close(self) -> None:
        if self.file:
            self.file.close()


def kinds(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is a sentinel smaller than all others."""
    step = np.sign(np.diff(text.astype(np.int32), append=-1))
    step[-1] = 1
    at = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _push_all(queue: BucketQueue, text: np.ndarray, wanted: np.ndarray, places: np.ndarray, common: np.ndarray, least: np.ndarray | None, depth: int) -> None:
    """Pushes the left neighbours of popped suffixes that are `wanted`; `least` is the running minimum for each symbol, if tracked."""
    before = places - 1
    ok = np.flatnonzero((places > 0) & wanted[before])
    if least is None:
        symbol = text[before[ok]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = before[ok[order]], symbol[order]
        heads = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]) if len(at) else ()
        for a, b in zip(heads, [*heads[1:], len(at)]):
            queue.push(int(symbol[a]), at[a:b], at[a:b])
        return
    running = np.minimum.accumulate(common) if len(common) else common
    if len(ok):
        symbol = text[before[ok]]
        order = np.argsort(symbol, kind="stable")
        sorted_ok, sorted_symbol = ok[order], symbol[order]
        heads = np.flatnonzero(np.r_[True, sorted_symbol[1:] != sorted_symbol[:-1]])
        for a, b in zip(heads, np.r_[heads[1:], len(sorted_ok)]):
            at, s = sorted_ok[a:b], int(sorted_symbol[a])
            # Least value after the previous push to this bucket, up to and with the inducer's own.
            between = np.minimum.reduceat(common[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            between[0] = min(between[0], least[s])
            queue.push(s, before[at], np.minimum(between + 1, depth))
        pushed = sorted_symbol[heads]
        last = sorted_ok[np.r_[heads[1:], len(sorted_ok)] - 1]
        rest = np.minimum.accumulate(common[::-1])[::-1]
        after = np.where(last + 1 < len(common), rest[np.minimum(last + 1, len(common) - 1)], depth)
        least[:] = np.minimum(least, running[-1])
        least[pushed] = after
    elif len(common):
        least[:] = np.minimum(least, running[-1])


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray | None, symbols: int, depth: int, memory: int = MEMORY):
    """All suffixes in order and each one's common prefix with its predecessor (capped), from seeds in order.

    Without `seed_common` only the order is told.
    """
    told = seed_common is not None
    first = text[seeds]
    bounds = np.searchsorted(first, np.arange(symbols + 1))
    queue, least = BucketQueue(symbols, memory), np.zeros(symbols, dtype=np.int64) if told else None
    large: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
    is_l = ~is_s
    for c in range(symbols):
        last = None
        for places, common in queue.pop(c):
            if last is None:
                common[0] = 0  # the first of a bucket shares nothing with what came before
            last = places[-1:]
            large[c].append((places, common))
            _push_all(queue, text, is_l, places, common, least, depth)
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            common = seed_common[a:b].copy() if told else seeds[a:b]
            if told:
                common[0] = 0 if last is None else common_prefix(text, last, seeds[a : a + 1], depth)[0]
            _push_all(queue, text, is_l, seeds[a:b], common, least, depth)
    queue.close()
    queue, least = BucketQueue(symbols, memory), np.zeros(symbols, dtype=np.int64) if told else None
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(symbols - 1, -1, -1):
        last = None
        for places, common in queue.pop(c):  # descending: common is with the entry popped before, the larger one
            if last is None:
                common[0] = 0
            last = places[-1:]
            out.append((places, common))
            _push_all(queue, text, is_s, places, common, least, depth)
        if large[c]:
            places = np.concatenate([p for p, _ in large[c]])[::-1]
            up = np.concatenate([x for _, x in large[c]])
            common = np.r_[0 if last is None or not told else common_prefix(text, places[:1], last, depth)[0], up[1:][::-1]]
            out.append((places, common))
            _push_all(queue, text, is_s, places, common, least, depth)
    queue.close()
    out.append((np.array([len(text) - 1]), np.zeros(1, dtype=np.int64)))  # nothing induces the sentinel
    places = np.concatenate([p for p, _ in out])[::-1]
    down = np.concatenate([x for _, x in out])
    return places, np.r_[0, down[1:][::-1]]


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Equal leading symbols of the different suffixes at a and b, up to `depth`; four symbols are compared at a time.

    The last symbol stands nowhere else, so two suffixes differ before one of them ends.
    """
    out, open_ = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    if len(a) < 256:
        for k in range(depth):
            open_ = open_[text[np.minimum(a[open_] + k, len(text) - 1)] == text[np.minimum(b[open_] + k, len(text) - 1)]]
            if not len(open_):
                break
            out[open_] += 1
        return out
    four = np.zeros(len(text) + depth + 4, dtype=np.uint64)
    four[: len(text)] = text
    for j in (1, 2):
        four[:-j] |= four[j:] << np.uint64(16 * j)
    for k in range(0, depth, 4):
        x = four[a[open_] + k] ^ four[b[open_] + k]
        apart = x != 0
        for bits in (16, 32, 48):
            out[open_[apart]] += (x[apart] & np.uint64((1 << bits) - 1)) == 0
        open_ = open_[~apart]
        out[open_] += 4
        if not len(open_):
            break
    return np.minimum(out, depth)


def sorted_seeds(text: np.ndarray, is_s: np.ndarray, symbols: int, depth: int, memory: int = MEMORY) -> np.ndarray:
    """The seeds in suffix order as far as `depth` symbols tell."""
    lms = np.flatnonzero(is_s & np.r_[False, ~is_s[:-1]])
    if len(lms) < 2:
        return lms
    rough = lms[np.argsort(text[lms], kind="stable")]
    places, _ = induce(text, is_s, rough, None, symbols, depth, memory)
    mark = np.zeros(len(text), dtype=bool)
    mark[lms] = True
    places = places[mark[places]]
    # Names: a seed substring reaches up to and with the next seed; equal neighbours in order share a name.
    number = np.empty(len(text), dtype=np.int64)
    number[lms] = np.arange(len(lms))
    order = number[places]
    following = order + 1
    ends = np.where(following < len(lms), lms[np.minimum(following, len(lms) - 1)] + 1, len(text))
    size = ends - places
    shared = common_prefix(text, places[:-1], places[1:], int(min(depth, size.max())))
    same = (shared >= np.minimum(size[:-1], depth)) & ((size[:-1] == size[1:]) | (shared >= depth))
    name = np.cumsum(np.r_[True, ~same])
    if name[-1] == len(name):
        return places
    # The string of names, sorted by rank doubling: after r rounds ranks tell 2^r seeds, at least 2^(r+1) symbols. A rank is the
    # first place of its group; only groups of several are sorted on.
    head = np.flatnonzero(np.r_[True, ~same])
    sizes = np.diff(np.r_[head, len(order)])
    rank = np.zeros(len(lms) + 1, dtype=np.int64)
    rank[order] = np.repeat(head, sizes) + 1
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    reach = 1
    while len(open_) and 2 * reach <= depth:
        at = order[open_]
        key = rank[at] * (len(lms) + 2) + rank[np.minimum(at + reach, len(lms))]
        by = np.argsort(key, kind="stable")
        order[open_], key = at[by], key[by]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[head, len(key)])
        rank[order[open_]] = np.repeat(open_[head], sizes) + 1
        open_ = open_[np.repeat(sizes > 1, sizes)]
        reach *= 2
    return lms[order]


def suffix_array(text: np.ndarray, symbols: int, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and capped common prefixes; `text` ends with its only 0, symbols are below `symbols`."""
    is_s = kinds(text)
    seeds = sorted_seeds(text, is_s, symbols, depth, memory)
    together = np.r_[0, common_prefix(text, seeds[:-1], seeds[1:], depth)]
    return induce(text, is_s, seeds, together, symbols, depth, memory)
