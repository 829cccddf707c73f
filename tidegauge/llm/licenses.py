"""License scans: fuzzy search for short notices.

A text becomes its lower-case words joined by single blanks. A notice of which at most k characters are wrong must
hold at least one of its k + 1 pieces unharmed (pigeonhole), so exact searches for the pieces locate every possible
place. The regex library's bounded-error matching then verifies the few characters around each candidate and
reports where the match starts and ends and how many edits it took. Nothing is sampled: a notice within its number
of edits is found wherever it stands.

Exact places of the base phrases are reported next to that. Null text counts as empty: no words, no places, no
labels, score 0. Equal texts give equal rows; repeated and null ids and other columns do no harm, an empty table gives no rows.
The work grows with the text and its candidates, however long it is.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import text_rows

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices for the fuzzy search: label, normalised text, edits allowed.
NOTICES = (
    ("gpl", "gnu general public license", 2),
    ("lgpl", "gnu lesser general public license", 2),
    ("agpl", "gnu affero general public license", 2),
    ("apache", "licensed under the apache license version 2 0", 3),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    ("mpl", "mozilla public license", 2),
    ("epl", "eclipse public license", 2),
    ("isc", "permission to use copy modify and or distribute this software", 4),
    ("boost", "boost software license", 2),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("cc-by-sa", "licensed under cc by sa", 1),
    ("public-domain", "dedicated to the public domain", 2),
    ("public-domain", "free and unencumbered software released into the public domain", 4),
    ("all-rights-reserved", "all rights reserved", 2),
    ("mit", "spdx license identifier mit", 1),
    ("apache", "spdx license identifier apache 2 0", 1),
    ("gpl", "spdx license identifier gpl", 1),
    ("bsd", "spdx license identifier bsd", 1),
    ("mpl", "spdx license identifier mpl 2 0", 1),
    ("cc0", "cc0 1 0 universal", 1),
    ("mit", "the software is provided as is without warranty of any kind express or implied", 5),
    ("bsd", "this software is provided by the copyright holders and contributors as is", 5),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors", 5),
)

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, start: long, end: long, edits: int>>"
)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the words with a blank around each, and how many there are."""
    words = (text or "").encode().translate(_LOWER).split()
    return b" " + b"".join(w + b" " for w in words), len(words)


def pieces(notice: bytes, k: int) -> list[tuple[int, bytes]]:
    """k + 1 pieces of about equal length with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def places(data: bytes, what: bytes) -> list[int]:
    """All starts, overlapping ones too."""
    out, at = [], data.find(what)
    while at >= 0:
        out.append(at)
        at = data.find(what, at + 1)
    return out


class NoticeSearch:
    def __init__(self, notices: tuple[tuple[str, str, int], ...]):
        self.notices = [(label, text.encode(), k) for label, text, k in notices]
        self.patterns = [regex.compile(b"(?:" + regex.escape(t) + b"){e<=%d}" % k, regex.BESTMATCH) for _, t, k in self.notices]
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.notices):
            for offset, piece in pieces(text, k):
                self.seeds.setdefault(piece, []).append((n, offset))
        self.verify = lru_cache(1 << 16)(self._verify)

    def _verify(self, n: int, window: bytes) -> tuple[int, int, int] | None:
        m = self.patterns[n].search(window)
        return m and (m.start(), m.end(), sum(m.fuzzy_counts))

    def spans(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits); of overlapping matches of one notice the one with fewest edits, then the first."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for piece, uses in self.seeds.items():
            if piece not in data:
                continue
            for at in places(data, piece):
                for n, offset in uses:
                    _, text, k = self.notices[n]
                    low = max(0, at - offset - k)
                    if m := self.verify(n, data[low : at - offset + len(text) + k]):
                        found.setdefault(n, set()).add((m[2], low + m[0], low + m[1]))
        out = []
        for n, matches in found.items():
            taken: list[tuple[int, int]] = []  # apart and by place: only the neighbours of a place can overlap
            for edits, a, b in sorted(matches):
                at = bisect_left(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b))
                    out.append((n, a, b, edits))
        return sorted(out, key=lambda s: (s[1], s[0]))

    def scan(self, text: str | None) -> tuple:
        data, n_words = normalised(text)
        base, labels = [], set()
        for phrase, label in BASE:
            if at := places(data, b" " + phrase.encode() + b" "):
                base += at
                labels.add(label)
        matches = self.spans(data)
        # Words before a place: blanks up to it, counted once for all places.
        asked = np.array([*base, *(a for _, a, _, _ in matches)], dtype=np.int64)
        blanks = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), asked, "right").tolist() if len(asked) else []
        starts = [min(blanks[: len(base)]) - 1, max(blanks[: len(base)]) - 1] if base else [None, None]
        spans = [(self.notices[n][0], k - (data[a] != 32), a, b, e) for (n, a, b, e), k in zip(matches, blanks[len(base) :])]
        closeness = [1 - e / len(self.notices[n][1]) for n, _, _, e in matches]
        return (
            n_words, len(base), *starts, ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})),
            max([*closeness, float(bool(base))]), [dict(zip(("label", "first_word", "start", "end", "edits"), s)) for s in spans],
        )


_SEARCHES: dict[tuple, NoticeSearch] = {}


def scan_notices(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str, int], ...] = NOTICES) -> DataFrame:
    """doc_id, word and base counts, labels, the closeness of the best match and all spans (in the normalised text)."""

    @F.pandas_udf(SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if notices not in _SEARCHES:
            _SEARCHES[notices] = NoticeSearch(notices)
        own = _SEARCHES[notices]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        out = pd.DataFrame([own.scan(t) for t in texts], columns=names)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return text_rows(df, id_col, text_col).select("doc_id", scan("text").alias("r")).select("doc_id", "r.*")
