"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidegauge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, `n_convs` int, x1 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    sequences = {}
    for c in told:
        h = zlib.crc32(str(c).encode()) % 6
        sequences[c] = told.get(c - c % 100, [])[:h] + told[c][h:]
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = {}
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in convs if len(sequences[c]) == len(node))))
        out[node] = (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(m) == len(node) + 1 for m in below),
            sum(not any(o[: len(m)] == m and o != m for o in below) for m in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def found(df, chunk=prefix_trie.CHUNK):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df, chunk).select(*COLUMNS).collect()), key=str)


def some_rows(seed, convs=60, words=3):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.choice([r.randrange(0, 12), r.randrange(100, 130), r.randrange(200, 215), 1000 + r.randrange(5)])
        if any(x[0] == c for x in rows):
            continue
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["", "aé", "b" * r.randrange(1, words + 1), None, "中文😀"]), "x", 1, "y"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("chunk", [2, prefix_trie.CHUNK])
def test_equal_to_a_dictionary_of_prefixes(spark, seed, chunk):
    rows = some_rows(seed)
    assert found(spark.createDataFrame(rows, SCHEMA), chunk) == brute(rows)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = some_rows(4, 20)
    rows += [(300, None, "user", "first"), (300, 1, None, None), (300, 1, "a", "x"), (300, 1, "a", "x"), (None, 1, "user", "nobody's"), (7777, 0, "user", "only"), (7778, 0, "user", "only")]
    rows = [(*x, None, None, None)[:7] for x in rows]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_all_conversations_without_turns(spark):
    gone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5][:4]
    rows = [(c, 0, "user", "away", "x", 1, "y") for c in gone]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    rows = [(400, t, "user", f"w{t % 7}", "x", 1, "y") for t in range(300)] + [(500 + k, t, "user", f"same {t}", "x", 1, "y") for k in range(60) for t in range(6)]
    assert found(spark.createDataFrame(rows, SCHEMA), 16) == brute(rows)
