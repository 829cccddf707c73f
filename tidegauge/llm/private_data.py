"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (`base_spans`) are the floor: what they find stays. Around them a semi-Markov model segments the rest: every
stretch of at most LONGEST characters that could be an address or a number is a candidate, scored as a whole by features of
the whole span (shape, number of digits, check digit, octets, separators, what stands before and after) and by the pair of
kinds of spans that stand next to each other. Dynamic programming over the candidates, whose length is bounded, picks
boundaries and kinds together; what is in no span scores zero. So two card numbers in a row, which the pattern takes for one
too long number, a number with a wrong check digit, telephone numbers without a plus and addresses written with "at" and "dot"
are found, and dates, versions and plain numbers are not.

The model is trained by the exact gradient of its likelihood (forward and backward sums over all segmentations) on labelled
lines: words of a bounded sample of the documents (SAMPLE rows, by the hash of the text) with invented data of known place and
kind, and look-alikes, put between them. It is a few hundred weights and does not grow with the documents.

Null text is empty, without spans. Texts of any length are searched whole: the work is linear, since patterns start at run
borders only and the model looks at LONGEST characters on either side of a digit, an @ or a written "at" or "dot". Spans are in
code points. Repeated rows and ids, null ids and other columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import text_rows

KINDS = ("email", "ip", "card", "phone")
#: Most characters and runs of digits of a candidate; characters between two spans that count as neighbours.
LONGEST, MOST_RUNS, GAP = 64, 7, 2
#: Documents whose words surround the invented data, lines made of them, passes, step and penalty of the training.
SAMPLE, LINES, PASSES, RATE, PENALTY = 400, 1200, 6, 0.3, 1e-4

Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octets(parts: Sequence[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start, then kind."""
    out: list[Span] = []
    low = at = 0
    while (at := text.find("@", at)) >= 0:
        # A local part reaches back to the last match or @ at most, so every character is looked at once.
        start = at - (len(own := text[low:at]) - len(own.rstrip(_LOCAL)))
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            low = m.end()
        at = low
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m.group().split("."))]
        for m in _CARD.finditer(text):
            if 14 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m.group())) <= 15]
    return _sorted(out)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Candidates and their features.

_SEED = re.compile(r"[0-9]+|@|[\[(]at[\])]|[\[( ]dot[\]) ]", re.IGNORECASE)
_RUN = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[ ().\[\]/-]{1,4}")
_DOTTED = re.compile(r"\.|\[\.\]|\(\.\)| \. ")
_MAIL = re.compile(
    r"[\w.%+-]{1,40}(?: ?@ ?|[ ]?[\[(]at[\])][ ]?| at )[\w-]{1,30}(?:(?:\.| ?\. |[ ]?[\[(]dot[\])][ ]?| dot )[\w-]{1,20}){1,4}", re.IGNORECASE
)
_MARK = re.compile(r"(@|[\[(]at[\])]| at )", re.IGNORECASE)


def _class(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "blank" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in ".,:;/+-_=#$%@\"'()" else "other"


@lru_cache(maxsize=50_000)
def _shape(span: str) -> tuple[str, str]:
    """With and without the lengths of runs."""
    some = re.sub(r"[^\W\d_]+", "a", span)
    return _RUN.sub(lambda m: f"<{min(len(m.group()), 20)}>", some), _RUN.sub("9", some)


def features(kind: str, span: str, before: str, after: str) -> list[str]:
    digits = _DIGITS.sub("", span)
    shape, rough = _shape(span)
    out = ["any", f"rough={rough[:24]}", f"before={before}", f"after={after}", f"edges={before},{after}"]
    if kind == "email":
        mark = m.group().strip().lower() if (m := _MARK.search(span)) else ""
        last = re.split(r"[^\w]+", span)[-1]
        return [f"{kind}:{x}" for x in (*out[:1], *out[2:], f"mark={mark}", f"blank={' ' in span}", f"last={'a' if last.isalpha() else '9'}{min(len(last), 5)}")]
    out += [f"digits={len(digits)}", f"shape={shape[:40]}", f"runs={len(_RUN.findall(span))}", f"starts={span[0] if not span[0].isdigit() else '9'}"]
    if kind == "card":
        out.append(f"check={luhn(digits)}")
    if kind == "ip":
        out += [f"octets={octets(_RUN.findall(span))}", f"dots={','.join(sorted(set(_DOTTED.findall(span))))}"]
    return [f"{kind}:{x}" for x in out]


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches, within a line, that hold whatever could be part of a candidate."""
    low = high = -1
    for m in _SEED.finditer(text):
        a = max(text.rfind("\n", max(0, m.start() - LONGEST), m.start()) + 1, m.start() - LONGEST, 0)
        b = text.find("\n", m.end(), m.end() + LONGEST)
        b = min(len(text), m.end() + LONGEST) if b < 0 else b
        if low < 0:
            low, high = a, b
        elif a <= high and "\n" not in text[high : m.start()]:
            high = max(high, b)
        else:
            yield low, high
            low, high = a, b
    if low >= 0:
        yield low, high


def candidates(text: str, low: int, high: int, taken: Sequence[tuple[int, int]] = ()) -> list[Span]:
    """Spans within an island that could be of a kind and don't touch what is taken (ascending)."""
    out: set[Span] = set()
    runs = [m.span() for m in _RUN.finditer(text, low, high)]
    for i, (start, _) in enumerate(runs):
        digits = dots = 0
        for j in range(i, min(i + MOST_RUNS, len(runs))):
            a, b = runs[j]
            if j > i:
                gap = text[runs[j - 1][1] : a]
                if not _BETWEEN.fullmatch(gap):
                    break
                dots += bool(_DOTTED.fullmatch(gap))
            digits += b - a
            if digits > 19 or b - start > LONGEST:
                break
            if j == i + 3 and dots == 3:
                out.add(("ip", start, b))
            starts = [start]
            if start > low and text[start - 1] in "+(":
                starts.append(start - 1)
                if start - 1 > low and text[start - 2 : start] == "+(":
                    starts.append(start - 2)
            for s in starts:
                if 14 <= digits and s == start:
                    out.add(("card", s, b))
                if 9 <= digits <= 15:
                    out.add(("phone", s, b))
    for m in _MAIL.finditer(text, low, high):
        out.add(("email", *m.span()))
        # Shorter by a last part or by a first one: the model tells where an address begins and ends.
        for x in re.finditer(r"[^\w-]", m.group()):
            if _MARK.search(text, m.start() + x.end(), m.end()) and text[m.start() + x.end()] not in " @([":
                out.add(("email", m.start() + x.end(), m.end()))
            elif _MAIL.fullmatch(text, m.start(), m.start() + x.start()):
                out.add(("email", m.start(), m.start() + x.start()))
    free = []
    ends = [b for _, b in taken]
    for s in out:
        k = bisect_right(ends, s[1])
        if k == len(taken) or taken[k][0] >= s[2]:
            free.append(s)
    return sorted(free, key=lambda s: (s[2], s[1], s[0]))


# The model: scores of candidates, sums and maxima over all ways to pick disjoint ones.


def _logsum(values: Sequence[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Model:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[tuple, float] = {}

    def score(self, text: str, span: Span) -> float:
        kind, a, b = span
        own, before, after = text[a:b], _class(text, a - 1), _class(text, b)
        digits = _DIGITS.sub("", own)
        key = (kind, _shape(own)[0], before, after, kind == "card" and luhn(digits), kind == "ip" and octets(_RUN.findall(own)), kind == "email" and own[-6:])
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = sum(self.weights.get(f, 0.0) for f in features(kind, own, before, after))
        return self.known[key]

    def pair(self, a: Span, b: Span) -> float:
        return self.weights.get(f"{a[0]}>{b[0]}", 0.0)

    def best(self, text: str, spans: list[Span]) -> list[Span]:
        """The disjoint spans of the highest score; spans come sorted by end."""
        ends = [s[2] for s in spans]
        top: list[float] = []  # the best that ends with a span
        back: list[int] = []
        so_far: list[tuple[float, int]] = []  # the best of the first spans, -1 for none of them
        for j, s in enumerate(spans):
            far, near = bisect_left(ends, s[1] - GAP, 0, j), bisect_right(ends, s[1], 0, j)
            value, came = so_far[far - 1] if far else (0.0, -1)
            for i in range(far, near):
                if (v := top[i] + self.pair(spans[i], s)) > value:
                    value, came = v, i
            top.append(value + self.score(text, s))
            back.append(came)
            so_far.append(max(so_far[-1] if so_far else (0.0, -1), (top[-1], j)))
        out, at = [], so_far[-1][1] if so_far else -1
        while at >= 0:
            out.append(spans[at])
            at = back[at]
        return out[::-1]

    def expected(self, scores: Sequence[float], spans: list[Span]) -> tuple[list[float], dict[str, float]]:
        """Probability of each span, and expected number of each pair of neighbours; spans come sorted by end."""
        n, ends = len(spans), [s[2] for s in spans]
        fore, sums = [0.0] * n, [0.0]  # sums[k]: all ways to pick from the first k spans
        near_of = []
        for j, s in enumerate(spans):
            far, near = bisect_left(ends, s[1] - GAP, 0, j), bisect_right(ends, s[1], 0, j)
            fore[j] = scores[j] + _logsum([sums[far], *(fore[i] + self.pair(spans[i], s) for i in range(far, near))])
            sums.append(_logsum([sums[-1], fore[j]]))
            near_of.append((far, near))
        # Backwards: all ways to go on after a span, gathered from those that may follow.
        back: list[float] = [0.0] * n
        for j in range(n - 1, -1, -1):
            after = [0.0]
            for k in range(j + 1, n):
                far, near = near_of[k]
                if j < far:
                    after.append(scores[k] + back[k])
                elif j < near:
                    after.append(scores[k] + back[k] + self.pair(spans[j], spans[k]))
            back[j] = _logsum(after)
        z = sums[-1]
        pairs: dict[str, float] = defaultdict(float)
        for k, (far, near) in enumerate(near_of):
            for i in range(far, near):
                pairs[f"{spans[i][0]}>{spans[k][0]}"] += math.exp(fore[i] + self.pair(spans[i], spans[k]) + scores[k] + back[k] - z)
        return [math.exp(a + b - z) for a, b in zip(fore, back)], pairs


def found(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and those that the model adds where the patterns found nothing."""
    base = base_spans(text)
    taken: list[tuple[int, int]] = []
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], b))
        else:
            taken.append((a, b))
    more: list[Span] = []
    for low, high in islands(text):
        spans = candidates(text, low, high, taken)
        if spans:
            more += model.best(text, spans)
    return base, more


# Training on lines of known content.


def _invented(r: random.Random) -> tuple[str | None, str]:
    """A piece of a line and its kind; None for a look-alike."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randrange(2, 9)))
    b = lambda: str(r.randrange(256))
    sep = r.choice([" ", "-", ".", ""])
    name = r.choice([w(), f"{w()}.{w()}", f"{w()}{n(2)}", f"{w()}_{w()}"])
    domain = r.choice([f"{w()}.com", f"{w()}{n(1)}.example.org", f"mail.{w()}.de"])
    at, dot = r.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", " . "), ("(at)", "."), ("[at]", ".")])
    card = [n(4), n(4), n(4), n(4)]
    area, first, last = n(3), n(3), n(4)
    kinds = {
        "email": [f"{name}@{domain}", f"{name}{at}{domain.replace('.', dot)}"],
        "ip": [".".join([b(), b(), b(), b()]), r.choice(["[.]", "(.)"]).join([b(), b(), b(), b()])],
        "card": ["".join(card), " ".join(card), "-".join(card), f"3{n(3)}{r.choice(' -')}{n(6)}{r.choice(' -')}{n(5)}"],
        "phone": [f"+{n(1)} ({area}) {first}-{last}", f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"{n(1)}-{area}-{first}-{last}", f"+{n(2)} {n(2)} {n(7)}", f"00{n(2)} {n(2)} {n(7)}", f"({area}){sep if sep != '.' else ' '}{first} {last}", f"+{n(11)}"],
        "": [
            n(r.randrange(1, 9)), f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(2)}", f"{n(3)},{n(3)}.{n(2)}", n(r.randrange(9, 13)), n(14), n(r.randrange(20, 30)),
            f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{300 + r.randrange(600)}.{b()}.{b()}.{500 + r.randrange(400)}", f"{w()} at {w()}", f"@{w()}", "".join(r.choice("0123456789abcdef") for _ in range(40)), f"{w()}{n(4)}", f"{n(2)}-{n(2)}", f"{n(4)}-{n(4)}",
            f"{n(4)}-{n(2)}-{n(2)} {n(2)}:{n(2)}", f"{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}", f"{n(3)} {n(3)} {n(3)}", f"{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", f"{n(8)}_{n(8)}", f"#{n(16)}{w()}", f"{w()}{n(16)}",
        ],
    }
    kind = r.choice([*KINDS, "", ""])
    return kind or None, r.choice(kinds[kind])


def labelled_line(r: random.Random, words: Sequence[str]) -> tuple[str, list[Span]]:
    """A line of words and invented data, and where the data stand."""
    line, spans = "", []
    for _ in range(r.randrange(1, 4)):
        some = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 6]))) if words else ""
        line += some + (r.choice([" ", " ", " ", ": ", " (", ", ", "\t"]) if some else "")
        kind, piece = _invented(r)
        if kind:
            spans.append((kind, len(line), len(line) + len(piece)))
        line += piece + r.choice([" ", " ", " ", ". ", ", ", ") ", "!! ", "### ", "; "])
    return line + (r.choice(words) if words else ""), spans


def train(words: Sequence[str], lines: int = LINES, passes: int = PASSES, seed: int = 11) -> dict[str, float]:
    """Weights by adaptive gradient ascent of the likelihood of the labelled lines."""
    r = random.Random(seed)
    cases = []
    for _ in range(lines):
        line, gold = labelled_line(r, words)
        for low, high in islands(line):
            spans = candidates(line, low, high)
            if spans:
                told = [features(k, line[a:b], _class(line, a - 1), _class(line, b)) for k, a, b in spans]
                inside = sorted((g for g in gold if g in set(spans)), key=lambda s: s[1])
                cases.append((spans, told, set(inside), inside))
    weights: dict[str, float] = defaultdict(float)
    scale: dict[str, float] = defaultdict(lambda: 1e-3)
    for _ in range(passes):
        r.shuffle(cases)
        for spans, told, gold, inside in cases:
            scores = [sum(weights[f] for f in fs) for fs in told]
            chance, pairs = Model(weights).expected(scores, spans)
            step: dict[str, float] = defaultdict(float)
            for s, fs, p in zip(spans, told, chance):
                d = (s in gold) - p
                if abs(d) > 1e-4:
                    for f in fs:
                        step[f] += d
            for a, b in zip(inside, inside[1:]):
                if 0 <= b[1] - a[2] <= GAP:
                    step[f"{a[0]}>{b[0]}"] += 1
            for f, p in pairs.items():
                step[f] -= p
            for f, d in step.items():
                d -= PENALTY * weights[f]
                scale[f] += d * d
                weights[f] += RATE * d / math.sqrt(scale[f])
    return {f: round(w, 5) for f, w in sorted(weights.items()) if abs(w) > 1e-3}


def sample_words(df: DataFrame, rows: int = SAMPLE) -> list[str]:
    """Words of letters from the texts with the smallest hashes, as the surroundings of the training lines."""
    some = df.where(F.col("text").rlike(r"\p{L}")).select(F.xxhash64("text").alias("h"), F.substring("text", 1, 200).alias("text")).orderBy("h", "text").limit(rows)
    return sorted({w for x in some.collect() for w in re.findall(r"[^\W\d_]{2,20}", x["text"])})


def private_spans(text: Column, weights: dict[str, float], digests: bool = True) -> Column:
    """struct of the counts of the patterns, their digest (or list) and all spans as kind:start:end."""
    base_name = "base_sha256" if digests else "base"

    @F.pandas_udf(f"n_email long, n_ip long, n_card long, n_phone long, {base_name} string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        model, rows = Model(weights), []
        for t in texts:
            base, more = found(t, model) if t else ([], [])
            told = ",".join("%s:%d:%d" % s for s in base)
            every = ",".join("%s:%d:%d" % s for s in _sorted(base + more)) if more else told
            rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(told.encode()).hexdigest() if digests else told, every))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", base_name, "spans"])

    return scan(text)


def find_private(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, digests: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (what the patterns find) and spans (with the model's)."""
    docs = text_rows(df, id_col, text_col)
    weights = train(sample_words(docs, sample))
    return docs.select("doc_id", private_spans(F.col("text"), weights, digests).alias("p")).select("doc_id", "p.*")
