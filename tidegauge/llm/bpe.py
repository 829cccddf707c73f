"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that no vocabulary token holds side by side can never end up in one token, whatever the
merges do. Every such pair is therefore a certain cut: the text falls into short fragments, each is merged on its
own, and the ids are put one after the other. White space is the commonest such cut (no token has any inside), so a
text is first split there; the cuts inside what remains come from a table of the byte pairs found in the vocabulary.

Results equal those of the tokenizers library with special tokens recognised in the text, none added, no
truncation, no padding. Text in scripts outside the Latin blocks is normalised and pre-split by that library's own
normaliser; only the splitting into fragments and the merging is done here.

Null text encodes like empty text: no ids, and decodes to the empty text. Equal texts get equal ids; repeated and null ids
do no harm. Texts of any length are encoded whole, fragment by fragment. Other columns are ignored but for those that
`token_table` is told to carry; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from tidegauge.llm.common import CACHE_ENTRIES, Remembered, built, only, text_rows

#: Fragments up to this many symbols are merged by scanning, longer ones with a heap.
SCANNED = 24
#: Characters of text whose ids leave a worker together.
BLOCK = 1 << 20


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ForcedBoundaryBPE:
    """Encoder and decoder for one byte-level BPE vocabulary with an end-of-word suffix (JSON text of the library)."""

    def __init__(self, spec: str, kept: int = CACHE_ENTRIES):
        parts = json.loads(spec)
        model = parts["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.library = Tokenizer.from_str(spec)
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.token_bytes = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.stand_in = _byte_characters()
        plain = (t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab)
        self.inside = {t[i : i + 2] for t in plain for i in range(len(t) - 1)}
        self.table = str.maketrans({chr(b): c for b, c in self.stand_in.items()})
        self.pattern = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.safe = regex.compile(f"[{''.join(map(regex.escape, self._safe_characters()))}]*")
        self.chunks = Remembered(self._encode_chunk, kept)
        self.words = Remembered(self._encode_word, kept)

    def _safe_characters(self) -> list[str]:
        """Latin characters that Python and the library lower-case and split alike (asked of the library, not assumed)."""
        good = []
        for n in (*range(33, 127), *range(0xA1, 0x180)):
            c = chr(n)
            low = self.library.normalizer.normalize_str(c)
            split = [self._characters(x) for x in self.pattern.findall(low)]
            if low == c.lower() and split == [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]:
                good.append(c)
        return good

    def _characters(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() and " " not in text else text.encode().decode("latin-1").translate(self.table)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the token strings joined by spaces: what the library gives for a vocabulary without decoder."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b" ".join(map(self.token_bytes.__getitem__, numbers))

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of a text without blanks and line ends; it may hold other white space and special tokens."""
        if self.safe.fullmatch(chunk) and not self.specials.search(chunk):
            low = chunk.lower()
            return b"".join([self.words[self._characters(w)] for w in ([low] if low.isalpha() else self.pattern.findall(low))])
        out, at = [], 0
        for m in (*self.specials.finditer(chunk), None):
            piece = self.library.normalizer.normalize_str(chunk[at : m.start() if m else len(chunk)])
            out += [self.words[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
            if m:
                out.append(self.special[m.group()].to_bytes(4, "little"))
                at = m.end()
        return b"".join(out)

    def fragments(self, word: str) -> list[list[str]]:
        """The symbols of a word, cut wherever the vocabulary has no token over the two neighbours."""
        inside, start, out = self.inside, 0, []
        if not inside.issuperset(map(str.__add__, word, word[1:])):
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in inside:
                    out.append(list(word[start:i]))
                    start = i
        out.append(list(word[start:]))
        out[-1][-1] += self.suffix
        return out

    def _encode_word(self, word: str) -> bytes:
        ids = array("I")
        for symbols in self.fragments(word):
            if len(symbols) > 1:
                symbols = self._scan(symbols) if len(symbols) <= SCANNED else self._queue(symbols)
            ids.extend(map(self.vocab.__getitem__, symbols))
        return ids.tobytes()

    def _scan(self, symbols: list[str]) -> list[str]:
        get, last = self.rank.get, 1 << 60
        ranks = [get(p, last) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) != last:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), last)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), last)
        return symbols

    def _queue(self, symbols: list[str]) -> list[str]:
        """The same merges for long fragments: a heap over pairs, a linked list over symbols."""
        n, rank = len(symbols), self.rank
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = a + b, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s in symbols if s]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (a few megabytes, whatever the corpus) for all executors."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int>: the ids of a text."""
    spec = vocabulary(spark, path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = built(ForcedBoundaryBPE, spec.value)
        return pd.Series([np.frombuffer(own.encode(t), "<i4") for t in texts], dtype=object)

    return ids(text)


def decoded(spark: SparkSession, ids: Column, path: str) -> Column:
    """string: the text that ids stand for; null ids are none."""
    spec = vocabulary(spark, path)

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        own = built(ForcedBoundaryBPE, spec.value)
        return pd.Series([own.decode(np.asarray([] if r is None else r, "<i4").tobytes()).decode() for r in rows], dtype=object)

    return text(ids)


def token_table(df: DataFrame, path: str, text_col: str = "text", carried: tuple[str, ...] = ("doc_id",), kept: int = CACHE_ENTRIES) -> DataFrame:
    """The carried columns, n_tokens, ids and decoded: the ids of a text and the text that they stand for.

    Rows leave a worker in blocks of about BLOCK characters, so neither the ids of a whole Arrow batch nor their decoded
    texts stand in memory together. A worker remembers `kept` words and as many chunks; results don't depend on either.
    """
    spec = vocabulary(df.sparkSession, path)
    key = f"bpe:{kept}:{path}"
    rows = df.select(*carried, F.col(text_col).alias("decoded"))
    schema = StructType([*rows.schema.fields[:-1], StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = only(key, lambda: ForcedBoundaryBPE(spec.value, kept))
        for batch in batches:
            ids, size, first = [], 0, 0
            for i, text in enumerate(batch.column(len(carried))):
                text = text.as_py() or ""
                ids.append(own.encode(text))
                size += len(text)
                if size >= BLOCK or i == batch.num_rows - 1:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32) // 4
                    values = np.frombuffer(b"".join(ids), "<i4")
                    texts = pa.array(map(own.decode, ids), pa.binary()).cast(pa.string())
                    here = batch.slice(first, len(ids)).columns[: len(carried)]
                    yield pa.RecordBatch.from_arrays([*here, pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(ends, values), texts], names=schema.names)
                    ids, size, first = [], 0, i + 1

    return rows.mapInArrow(there_and_back, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, for tables too large to keep the ids of."""
    spec = vocabulary(df.sparkSession, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        own = built(ForcedBoundaryBPE, spec.value)
        rows = []
        for t in texts:
            ids = own.encode(t)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return text_rows(df, id_col, text_col).select("doc_id", digests("text").alias("r")).select("doc_id", "r.*")
