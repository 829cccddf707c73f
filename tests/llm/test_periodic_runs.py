"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import time
import zlib

import pytest

from tidegauge.llm import periodic_runs

SCHEMA = "doc_id long, text string, n_runs string, start int, r string"


def brute_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p) and (i, j + p) not in out:
                out[i, j + p] = p
            i = j + 1
    return sorted(((a, b - a, p) for (a, b), p in out.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def fibonacci(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, a
    return [w.encode() for w in a[:n]]


def some_texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        letters = "abcdefgh"[: r.choice([1, 2, 2, 3, 8])]
        w = [r.choice(letters).encode() for _ in range(r.randrange(0, 90))]
        for _ in range(r.randrange(0, 3)):
            p = r.randrange(1, 20)
            piece = [r.choice(letters).encode() for _ in range(p)] * r.randrange(1, 8)
            at = r.randrange(0, len(w) + 1)
            w[at:at] = piece[: r.randrange(len(piece) + 1)]
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    texts = some_texts(seed, 150)
    assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]


def test_repetitive_texts():
    texts = [fibonacci(400), [b"a"] * 300, [b"a", b"b"] * 150 + [b"c"] + [b"a", b"b"] * 80, [b"x"] * 11, [b"x"] * 12, [], ([b"a"] * 20 + [b"b"]) * 10]
    assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]


def test_long_texts_in_seconds():
    began = time.time()
    r = random.Random(1)
    piece = [str(r.randrange(1000)).encode() for _ in range(70_001)]
    found = periodic_runs.runs_of([[b"a"] * 300_000, piece * 3 + piece[:5], fibonacci(100_000)])
    assert found[0] == [(0, 300_000, 1)]
    assert (0, 210_008, 70_001) in found[1]
    assert time.time() - began < 60


def test_few_words_do_not_run():
    assert periodic_runs.runs_of([[b"a", b"b"] * 5, [b"a"] * 11]) == [[], []]


def test_operator_on_awkward_rows(spark, monkeypatch):
    planted = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0][:12]
    words = [" ".join(w.decode() for w in t) for t in some_texts(9, 60)]
    rows = [(d, t, "x", 1, "y") for d, t in enumerate(words)] + [(d, words[d % 60] + " tail of words that differ", None, None, None) for d in planted]
    rows += [(401, None, "x", 1, "y"), (402, "", "x", 1, "y"), (403, " \n\t", "x", 1, "y"), (404, "nb sp   " * 9, "x", 1, "y"), (None, "a " * 30, "x", 1, "y"), (405, "É\x0b" * 13, "x", 1, "y"), (405, "É\x0b" * 13, "x", 1, "y")]
    monkeypatch.setattr(periodic_runs, "BLOCK", 500)
    got = periodic_runs.find_runs(spark.createDataFrame(rows, SCHEMA), rebuild=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(r[0], r[1]) for r in rows), key=str)


def test_texts_come_out_without_digests(spark):
    df = spark.createDataFrame([(1, "go " * 14 + "on", None, None, None)], SCHEMA)
    row = periodic_runs.find_runs(df, digests=False).first()
    assert (row["runs"], row["collapsed"], row["exponent_milli"]) == ("0,14,1\n", "go on", 14000)


def test_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA), rebuild=True).collect() == []
