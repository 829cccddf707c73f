"""Personal data: the patterns against plain regular expressions, the model by exact enumeration and held-out lines."""

import hashlib
import itertools
import math
import random
import re
import time

import pytest

from tidegauge.llm import private_data as pd_

SCHEMA = "doc_id long, text string, n_email string, spans int, p string"
WORDS = "the of and to reading from a small book Ériç über keit menté".split()
#: The patterns as they are asked for.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    keep = {
        "email": lambda s, d: True, "ip": lambda s, d: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s, d: 14 <= len(d) <= 19 and plain_luhn(d), "phone": lambda s, d: 10 <= len(d) <= 15,
    }
    out = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if keep[k](m.group(), re.sub("[^0-9]", "", m.group()))]
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@pytest.fixture(scope="module")
def model():
    return pd_.Model(pd_.train(WORDS))


def test_patterns_equal_plain_regular_expressions():
    r = random.Random(3)
    pieces = ["a", "Z9", "@", ".", "-", "+", " ", "1", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", "(", ")", "_", "é", "٣", "１", "x.y", "com", "\n", "0", "00"]
    for _ in range(6000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 22)))
        assert pd_.base_spans(text) == plain(text), text


def test_best_and_expected_equal_enumeration(model):
    r = random.Random(8)
    tried = 0
    while tried < 60:
        line, _ = pd_.labelled_line(r, WORDS)
        spans = [s for low, high in pd_.islands(line) for s in pd_.candidates(line, low, high)]
        spans = sorted(spans, key=lambda s: (s[2], s[1], s[0]))[:9]
        if len(spans) < 2:
            continue
        tried += 1
        scores = [model.score(line, s) for s in spans]
        ways = []
        for k in range(len(spans) + 1):
            for chosen in itertools.combinations(range(len(spans)), k):
                by_start = sorted(chosen, key=lambda i: spans[i][1])
                if all(spans[a][2] <= spans[b][1] for a, b in zip(by_start, by_start[1:])):
                    near = sum(model.pair(spans[a], spans[b]) for a, b in zip(by_start, by_start[1:]) if spans[b][1] - spans[a][2] <= pd_.GAP)
                    ways.append((sum(scores[i] for i in chosen) + near, chosen))
        top = max(w for w, _ in ways)
        best = model.best(line, spans)
        assert math.isclose(next(w for w, c in ways if [spans[i] for i in sorted(c, key=lambda i: spans[i][1])] == best), top, abs_tol=1e-9)
        z = sum(math.exp(w - top) for w, _ in ways)
        chance, _ = model.expected(scores, spans)
        for i, p in enumerate(chance):
            assert math.isclose(p, sum(math.exp(w - top) for w, c in ways if i in c) / z, abs_tol=1e-9)


def test_held_out_lines(model):
    r = random.Random(1234)
    hit = extra = missed = 0
    for _ in range(1000):
        line, gold = pd_.labelled_line(r, [w[::-1] for w in WORDS])
        base, more = pd_.found(line, model)
        floor, gold = set(base), set(gold)
        hit += len(gold & (floor | set(more)))
        missed += len(gold - floor - set(more))
        extra += len(set(more) - gold)
    assert hit / (hit + missed) > 0.97 and hit / (hit + extra) > 0.97


@pytest.mark.parametrize(
    "text, spans",
    [
        ("la 7536784127813050 4845168114407329 x", "card:3:19,card:20:36"),
        ("call (017) 555-7713!!", "phone:5:19"),
        ("wrong 9807915762804490 digit", "card:6:22"),
        ("bob at mail dot com", "email:0:19"),
        ("on 2024-05-12 10:30 Version 2.0, CC BY-NC 4.0. token = \"681c09b8e90e7e8c9575180f595f646cf2969054\"", ""),
    ],
)
def test_what_the_model_adds(model, text, spans):
    base, more = pd_.found(text, model)
    assert ",".join("%s:%d:%d" % s for s in sorted(base + more, key=lambda s: s[1])) == spans


def test_linear_on_long_texts(model):
    began = time.time()
    for text in ("a" * 1_000_000, "a@" * 200_000, "1" * 300_000, "1 " * 60_000, "+1" + " " * 500_000, "1." * 60_000, "x " * 500_000 + "a@b.cd"):
        pd_.found(text, model)
    assert time.time() - began < 60


def test_operator_on_awkward_rows(spark):
    r = random.Random(77)
    texts = [pd_.labelled_line(r, WORDS)[0] for _ in range(80)] + [None, "", " \n", "a@b", "é@x.yz", "😀 1.2.3.4 😀 x@y.zz", "no data here " * 3000 + "me@there.org"]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, "1.2.3.4", None, None, None), (3, "1.2.3.4", None, None, None), (3, "1.2.3.4", None, None, None)]
    got = pd_.find_private(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)

    def told(doc_id, text):
        spans = plain(text or "")
        listed = ",".join("%s:%d:%d" % s for s in spans)
        return (doc_id, *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest())

    assert sorted((tuple(x)[:6] for x in got), key=str) == sorted((told(i, t) for i, t, *_ in rows), key=str)
    texts_of = {}
    for i, t, *_ in rows:
        texts_of.setdefault(i, set()).update(("%s:%d:%d" % s for s in plain(t or "")))
    for x in got:
        have = [s for s in x["spans"].split(",") if s]
        assert have == sorted(have, key=lambda s: (int(s.split(":")[1]), pd_.KINDS.index(s.split(":")[0]), int(s.split(":")[2])))
        if x["doc_id"] not in (3, None):
            assert texts_of[x["doc_id"]] <= set(have)


def test_empty_table(spark):
    assert pd_.find_private(spark.createDataFrame([], SCHEMA)).collect() == []
