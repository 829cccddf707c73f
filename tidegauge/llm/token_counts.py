"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest vocabulary piece at every place of a word. The automaton is a trie
over the pieces in which every node knows, should the next letter not go on, how many pieces greedy matching would
have cut off by then (popped) and at which node the rest stands (failure link). One pass over the letters adds up
popped counts: no piece is ever built and no letter is read twice.

Pieces come from a public vocabulary: those with its word mark start words, the others continue them. A word that
the vocabulary cannot spell counts as one unknown token, as word-piece tokenizers do. Words are bounded by ASCII white
space. Null or empty text has no words and no tokens; equal texts get equal rows. Texts of any length are counted whole,
other columns are ignored, repeated and null ids do no harm, an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections import deque

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACES, Remembered, only, text_rows

MARK = "▁"
#: All white space that bounds words, as blanks.
_BLANKS = str.maketrans({c: " " for c in SPACES})


def pieces_of(model: bytes) -> list[str]:
    """The ordinary pieces of a sentence-piece model: no control, unknown or byte pieces."""
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class LongestMatch:
    """The automaton; `count(word)` is (tokens, unknown 0 or 1)."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.popped, final = [-1], [0], [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.link.append(-1)
                    self.popped.append(0)
                    final.append(False)
                node = self.next[node][c]
            final[node] = True
        # Breadth first, so that a parent's link is known: a whole piece is popped as itself and leaves the empty rest;
        # any other node pops what its parent popped and what the parent's rest pops until the last letter fits.
        queue = deque(self.next[0].items())
        todo = deque((0, c, n) for c, n in queue)
        while todo:
            parent, c, node = todo.popleft()
            if final[node]:
                self.link[node], self.popped[node] = 0, 1
            else:
                rest, pops = self.link[parent], self.popped[parent]
                while rest >= 0 and c not in self.next[rest]:
                    pops += self.popped[rest]
                    rest = self.link[rest]
                if rest >= 0:
                    self.link[node], self.popped[node] = self.next[rest][c], pops
            todo.extend((node, x, n) for x, n in self.next[node].items())
        self.words = Remembered(self.count)

    def count(self, word: str) -> tuple[int, int]:
        step, link, popped = self.next, self.link, self.popped
        node = total = 0
        for c in MARK + word:
            while (onward := step[node].get(c)) is None:
                total += popped[node]
                node = link[node]
                if node < 0 or not (node or c in step[0]):
                    return 1, 1
            node = onward
        while node > 0:  # the word has ended: pop what is left
            total += popped[node]
            node = link[node]
        return (1, 1) if node < 0 else (total, 0)

    def text(self, text: str | None) -> tuple[int, int, int]:
        words = (text or "").translate(_BLANKS).split(" ") if text else []
        found = [self.words[w] for w in words if w]
        return len(found), sum([n for n, _ in found]), sum([u for _, u in found])


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words) under the vocabulary file at `path`."""
    with open(path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # half a megabyte, whatever the corpus
    key = f"pieces:{path}:{os.path.getsize(path)}"

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        own = only(key, lambda: LongestMatch(pieces_of(spec.value)))
        return pd.DataFrame([own.text(t) for t in texts], columns=["n_words", "n_tokens", "n_unknown"])

    return text_rows(df, id_col, text_col).select("doc_id", counted("text").alias("r")).select("doc_id", "r.*")
