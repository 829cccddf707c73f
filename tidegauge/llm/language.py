"""Language ID by segmentation-marginalised unigrams.

Each language has its own probability for every piece of one fixed public vocabulary. A word's probability under a
language is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. Learning is expectation maximisation: forward-backward gives the expected piece counts of the training words,
Spark adds them up over all training rows per language and piece (at most vocabulary x languages rows, which is what
the driver sees), and smoothed shares are the next probabilities. The first round starts from equal piece
probabilities, which favours segmentations into few pieces.

Words are runs of letters, lower-cased. Letters that no piece spells cost a fixed small probability. A text that is
null or has no letter gets `und` with score 0, and so does every text when nothing was learned. The score is the
posterior of the predicted language under equal priors; ties go to the smallest language value. Equal texts get equal
predictions. Texts of any length are read whole, words block by block; other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import only
from tidegauge.llm.token_counts import MARK, pieces_of

UNDETERMINED = "und"
#: Probability of a letter that the vocabulary doesn't have, in every language.
UNKNOWN = 1e-7
#: Added to every expected count before shares are taken.
SMOOTHING = 0.05
#: Most language values that may be learned; the model is vocabulary x languages.
MOST_LANGUAGES = 1000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; numerals such as a half or a Roman eight are no letters."""
    words = _WORD.findall(text.lower()) if text else []
    if not words or text.isascii() or "".join(words).isalpha():
        return words
    return [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _prefix_sums(strings: list[str]) -> np.ndarray:
    """Polynomial hashes of all prefixes of strings of one length, by string and length."""
    n = len(strings[0])
    codes = np.array(strings, dtype=f"U{n}").view(np.uint32).reshape(len(strings), n).astype(np.uint64)
    codes = (codes ^ (codes << np.uint64(21))) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.zeros((len(strings), n + 1), dtype=np.uint64)
    for i in range(n):
        sums[:, i + 1] = sums[:, i] * _BASE + codes[:, i]
    return sums


def _finished(hashes: np.ndarray, n: int) -> np.ndarray:
    h = (hashes + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _spelled(strings: list[str]) -> list[np.ndarray]:
    """The hash of each whole string (all of one length)."""
    return [_finished(_prefix_sums(strings)[:, -1], len(strings[0]))]


class Unigrams:
    """Piece probabilities per language: an array of pieces x languages; the row after the last is the unknown letter.

    Words are worked on in blocks: the lattice of a block is four flat arrays (word, start, end, piece), and one step of
    the forward or backward recursion handles the same end or start of all its words.
    """

    def __init__(self, pieces: list[str], shares: np.ndarray):
        self.shares = np.vstack([shares, np.full((1, shares.shape[1]), UNKNOWN)])
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces))
        keys = np.array([int(_spelled([p])[-1][0]) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 20, dtype=bool)  # most substrings are told from pieces by 20 bits of their hash
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, shares.shape[1]))

    def lattice(self, words: list[str]) -> np.ndarray:
        """Edges (word, start, end, piece); a letter without a piece of its own gets the unknown one.

        Substrings of all words of a length are looked up together by 64-bit hashes.
        """
        out, lengths = [], np.array([len(w) for w in words])
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            sums = _prefix_sums([MARK + words[i] for i in which])
            for long in range(1, min(self.longest, int(n) + 1) + 1):
                hashes = _finished(sums[:, long:] - sums[:, :-long] * _power(long), long)
                row, a = np.nonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
                found = hashes[row, a]
                at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                hit = self.keys[at] == found
                row, a, piece = row[hit], a[hit], self.order[at[hit]]
                if long == 1:
                    alone = np.ones(hashes.shape, dtype=bool)
                    alone[row, a] = False
                    more, b = np.nonzero(alone)
                    row, a, piece = np.r_[row, more], np.r_[a, b], np.r_[piece, np.full(len(more), self.unknown)]
                out.append(np.stack([which[row], a, a + long, piece], axis=1))
        return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 4), np.int64)

    def _sweep(self, n_words: int, at: np.ndarray, to: np.ndarray, word: np.ndarray, piece: np.ndarray, first: np.ndarray, step: int):
        """Mantissas and exponents (powers of two) of the sums of all paths, by place and word."""
        size = int(max(at.max(initial=0), to.max(initial=0))) + 1
        sums = np.zeros((size, n_words, self.shares.shape[1]))
        power = np.zeros((size, n_words), dtype=np.int64)
        sums[first, np.arange(n_words)] = 1
        order = np.lexsort((word, to))
        at, to, word, piece = at[order], to[order], word[order], piece[order]
        bounds = np.searchsorted(to, np.arange(size + 1))
        for place in range(size) if step > 0 else range(size - 1, -1, -1):
            some = slice(bounds[place], bounds[place + 1])
            w, a = word[some], at[some]
            if not len(w):
                continue
            heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            top = np.maximum.reduceat(power[a, w], heads)
            shift = power[a, w] - np.repeat(top, np.diff(np.r_[heads, len(w)]))
            total = np.add.reduceat(np.ldexp(sums[a, w] * self.shares[piece[some]], np.maximum(shift, -1000)[:, None]), heads)
            exponent = np.frexp(total.max(axis=1))[1]
            sums[place, w[heads]] = np.ldexp(total, -exponent[:, None])
            power[place, w[heads]] = top + exponent
        return sums, power

    def forward(self, words: list[str], edges: np.ndarray):
        w, a, end, k = edges.T
        return self._sweep(len(words), a, end, w, k, np.zeros(len(words), int), 1)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Words x languages."""
        if not words:
            return np.zeros((0, self.shares.shape[1]))
        sums, power = self.forward(words, self.lattice(words))
        at = np.array([len(w) + 1 for w in words]), np.arange(len(words))
        return np.log(np.maximum(sums[at], 1e-300)) + power[at][:, None] * math.log(2)

    def expected(self, words: list[str], times: np.ndarray, into: np.ndarray) -> None:
        """Adds to `into` how often each piece is expected in words that occur `times` (words x languages).

        A model of one column holds for all languages.
        """
        edges = self.lattice(words)
        w, a, end, k = edges.T
        ends = np.array([len(x) + 1 for x in words])
        ahead, up = self.forward(words, edges)
        back, down = self._sweep(len(words), end, a, w, k, ends, -1)
        every = np.arange(len(words))
        share = ahead[a, w] * self.shares[k] * back[end, w] / np.maximum(ahead[ends, every], 1e-300)[w]
        share = np.ldexp(share, np.clip(up[a, w] + down[end, w] - up[ends, every][w], -1000, 1000)[:, None]) * times[w]
        for j in range(into.shape[1]):
            into[:, j] += np.bincount(k, weights=share[:, j], minlength=len(into))

    def text_sums(self, texts: Iterable[list[str]], table_words: int) -> Iterator[np.ndarray | None]:
        """Log-probability by language of each text (None: no words), from a bounded table of words met before."""
        for block in _blocks(texts, BLOCK_WORDS):
            new = list({w for words in block for w in words if w not in self.rows})
            if len(self.rows) + len(new) > table_words:
                self.rows, self.table = {}, self.table[:0]
                new = list({w for words in block for w in words})
            found = [self.log_probabilities(some) for some in _by_length(new)]
            first = len(self.rows)
            self.rows.update((w, first + i) for i, w in enumerate(w for some in _by_length(new) for w in some))
            self.table = np.vstack([self.table, *found])
            rows, table = self.rows.__getitem__, self.table
            yield from (table[[*map(rows, words)]].sum(axis=0) if words else None for words in block)


#: Words of texts that are worked on together, distinct words kept in a worker's table, words of one lattice.
BLOCK_WORDS, TABLE_WORDS, LATTICE_WORDS = 300_000, 800_000, 4_000


def _blocks(texts: Iterable[list[str]], bound: int):
    block, n = [], 0
    for words in texts:
        block.append(words)
        n += len(words)
        if n >= bound:
            yield block
            block, n = [], 0
    if block:
        yield block


def _by_length(words: list[str]):
    """Lattices of words of like length, so that one long word doesn't widen those of many short ones."""
    words, start = sorted(words, key=lambda w: (len(w), w)), 0
    for i, w in enumerate(words):
        if i > start and (i - start + 1) * (len(w) + 1) > LATTICE_WORDS * 16:
            yield words[start:i]
            start = i
    if words:
        yield words[start:]


def _counted(frames, model: Unigrams, languages: list[str], block_words: int):
    """(language, piece, expected count) of a task's rows, worked on in blocks of bounded size."""
    column = {x: i for i, x in enumerate(languages)}
    total = np.zeros((len(model.shares), len(languages)))
    seen = [Counter() for _ in languages]

    def settle():
        for some in _by_length(list(set().union(*seen))):
            model.expected(some, np.array([[c[w] for c in seen] for w in some], dtype=float), total)
        for c in seen:
            c.clear()

    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"]):
            seen[column[lang]].update(words_of(text))
            if sum(map(len, seen)) > block_words:
                settle()
    settle()
    total[-1] = 0  # the unknown letter isn't learned
    k, j = np.nonzero(total)
    yield pd.DataFrame({"language": j, "piece": k, "expected": total[k, j]})


def learn(df: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", rounds: int = 1, block_words: int | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and piece shares learned from all rows whose language is not null."""
    spark = df.sparkSession
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    if rounds < 1:
        raise ValueError("at least one round")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language values")
    with open(path, "rb") as f:
        pieces = pieces_of(f.read())
    shares = np.full((len(pieces), 1), 1 / len(pieces))  # the same for all languages: one column does
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast((pieces, shares))

        def count(frames, sent=sent):
            only("learning", dict)  # nothing else is needed meanwhile
            return _counted(frames, Unigrams(*sent.value), languages, block_words or BLOCK_WORDS)

        sums = rows.mapInPandas(count, "language int, piece int, expected double").groupBy("language", "piece").agg(F.sum("expected").alias("n"))
        got = sums.toPandas()  # at most pieces x languages rows
        counts = np.full((len(pieces), len(languages)), SMOOTHING)
        counts[got["piece"], got["language"]] += got["n"]
        shares = counts / counts.sum(axis=0)
    return languages, shares


def predicted(df: DataFrame, text: Column, path: str, languages: list[str], shares: np.ndarray, table_words: int | None = None) -> Column:
    """struct<lang_pred, score>: the most probable language of a text."""
    with open(path, "rb") as f:
        pieces = pieces_of(f.read())
    sent = df.sparkSession.sparkContext.broadcast((pieces, shares.astype("float32")))
    key = f"language:{hash((shares.tobytes(), *languages))}"

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = only(key, lambda: Unigrams(sent.value[0], sent.value[1].astype("float64")))
        out, split = [], (words_of(t) if languages else [] for t in texts)  # split as the blocks ask for it
        for total in model.text_sums(split, table_words or TABLE_WORDS):
            if total is None:
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(total.argmax())
            out.append((languages[best], 1 / math.fsum(np.exp(total - total[best]))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict(text)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned on the rows that are not held out, applied to all."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(F.col(id_col)).alias("held_out"))
    languages, shares = learn(rows.where(~F.col("held_out")), path, rounds=rounds)
    told = predicted(df, F.col("text"), path, languages, shares)
    return rows.select("doc_id", "held_out", told.alias("r")).select("doc_id", "held_out", "r.*")
