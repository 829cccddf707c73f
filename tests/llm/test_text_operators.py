"""Every text operator against a brute-force version, on rows that are awkward on purpose."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import bpe, decontaminate, language, licenses, line_dedup, quality, sharding, simhash, suffix_dedup, suffixes, token_counts
from tidegauge.llm.common import free_name
from tidegauge.session import materialise

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, labels string, `__hash` int"
SMALL = "/root/testdata/sf0.001"


def awkward():
    """Null, empty, blank, letterless, short, repeated, very long, near and exact copies, odd scripts, null keys."""
    r = random.Random(5)
    say = lambda n, w="the of and to reading from a small book over there with".split(): " ".join(r.choice(w) + r.choice(["", "", ",", "ly"]) for _ in range(n))
    long = say(4000)
    base = say(120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \n\t ", "12 34 !!", "one two", "ÉÈ ñ ß İ Σ 中文 text", long, base, base, " ".join(near), base + "\nLicensed under the Apache License, Version 2.0.",
        "a" * 3000, "ab " * 600, "This work is licenced under the GNU General Public Licence, version 3.", say(30) + "\n" + say(30) + "\n" + say(30),
        "x\n\n\nx\ny", "it's <|endoftext|> don't", "\x00\x1c\x85 nbsp here", long[:2000] + "middle" + long[2000:],
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], (f"s{i % 4}", None)[i % 5 == 4], 0, "x", "y", 1) for i, t in enumerate(texts)]
    return rows + [rows[7], (None, base, "en", "s1", 0, "x", "y", 1), (None, base, "en", "s1", 0, "x", "y", 1), (3, say(50), None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = awkward()
    items = [" ".join(rows[7][1].split()[10:40]), "one two", None, "", "nothing like it anywhere in the rows at all", rows[6][1].split()[900].upper(), " ".join(rows[7][1].split()[50:53]), "Apache License, Version\t2.0."]
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def texts_by_id(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


def test_free_names_avoid_any_case(docs):
    assert free_name(docs, "LANG") == "LANG_"


# ---- license scans -----------------------------------------------------------------------


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), at


def test_license_base_places_equal_a_plain_search(spark, docs):
    own = spark.createDataFrame([(100, "CC BY cc by-sa; MIT license.mit LICENSE"), (101, "gnu general public license" * 3)], "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), own, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")):
        got = licenses.scan_notices(table).collect()
        want = []
        for r in table.collect():
            n, at = base_places(r["text"])
            starts = [i for i, _ in at]
            want.append((r["doc_id"], n, len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
        assert sorted(map(repr, [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got])) == sorted(map(repr, want))
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def closest(text, notice):
    """Least edits over all substrings (semi-global alignment)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_fuzzy_notices_are_found_exactly_within_their_edits():
    r, search = random.Random(2), licenses.NoticeSearch(licenses.NOTICES)
    for _ in range(60):
        n = r.randrange(len(licenses.NOTICES))
        label, notice, k = licenses.NOTICES[n]
        s = list(notice)
        for _ in range(r.randrange(k + 3)):
            i = r.randrange(len(s))
            s[i : i + 1] = r.choice([[], [r.choice("abc")], [s[i], "x"]])
        data, _ = licenses.normalised("some words " + "".join(s) + " and more")
        found = [x for x in search.spans(data) if x[0] == n]
        assert bool(found) == (closest(data, notice.encode()) <= k)
        assert all(e <= k for _, _, _, e in found)


# ---- quality rules -----------------------------------------------------------------------


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many, held = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            held.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(held) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(held), failed


def test_quality_counts_equal_a_plain_count(spark, docs):
    for table in (docs, spark.read.parquet(f"{SMALL}/documents.parquet")):
        got = quality.judge(table).collect()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        assert sorted(map(repr, [(r["doc_id"], *(r[c] for c in names)) for r in got])) == sorted(map(repr, [(r["doc_id"], *base_counts(r["text"])) for r in table.collect()]))
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_fences_reject_outliers_of_their_group_only(spark):
    r = random.Random(1)
    clean = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(99)) for _ in range(60)), "en", f"s{i % 2}") for i in range(300)]
    noisy = [(1000 + i, t.replace(" ", "### "), "en", "s0") for i, t, _, _ in clean[:5]]
    got = {x["doc_id"]: x["kept"] for x in quality.judge(spark.createDataFrame(clean + noisy, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(5))


def test_each_quality_measure_rejects_outliers_of_its_group(spark):
    r = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in ("al", "be", "ga", "de", "ep") for b in ("pha", "ta", "mma", "lta") for c in range(10, 99)]
    plain = lambda n=60: [r.choice(vocabulary) for _ in range(n)]
    lined = lambda w: "\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6))
    clean = [(i, lined(plain()), "en", f"s{i % 2}") for i in range(400)]
    symbols = [lined([w + "#" * (k % 3 == 0) for k, w in enumerate(plain())]) for _ in range(3)]
    upper = [lined([w.upper() if k % 4 == 0 else w for k, w in enumerate(plain())]) for _ in range(3)]
    short = ["ab", "cd", "ef"]
    lines = ["\n".join([" ".join(plain(9)) for _ in range(9)] + short * 2) for _ in range(3)]
    window = plain(13)
    repeats = [lined(plain(70) + window + plain(31) + window + plain(29)) for _ in range(3)]
    long = [lined([w * 4 for w in plain()]) for _ in range(3)]
    tiny = [lined([w[:2] for w in plain()]) for _ in range(2)]
    planted = {"symbol_rate": symbols, "upper_rate": upper, "duplicate_line_rate": lines, "repeat_rate": repeats, "word_length": long + tiny}
    rows, kinds = list(clean), {}
    for m, texts in planted.items():
        for t in texts:
            kinds[1000 + len(kinds)] = m
            rows.append((999 + len(kinds), t, "en", "s0"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality.judge(docs).collect()}
    assert all(got[i]["kept"] for i in range(400))
    wrong = [(i, m) for i, m in kinds.items() if got[i]["base_failed"] or got[i]["kept"]]
    assert not wrong
    # Each is outside by its own measure alone.
    measures = materialise(quality.measured(docs), "measured")
    t = {x["t_source"]: x for x in quality.thresholds(measures).collect()}["s0"]
    for x in measures.where("doc_id >= 1000").collect():
        out = [m for m in quality.MEASURES if x[m] > t[f"{m}_high"] or (m in quality.TWO_SIDED and x[m] < t[f"{m}_low"])]
        assert kinds[x["doc_id"]] in out


def test_notices_in_long_texts_in_seconds():
    began = time.time()
    search = licenses.NoticeSearch(licenses.NOTICES)
    row = search.scan("all rights reserved " * 130_000 + "released under the mit license")
    assert row[0] == 3 * 130_000 + 5 and len([s for s in row[7] if s["label"] == "all-rights-reserved"]) == 130_000
    assert row[5] == "all-rights-reserved,mit" and row[3] == row[0] - 2
    assert time.time() - began < 60


def test_numerals_are_no_letters():
    assert language.words_of("½ ² Ⅷ ①②") == [] and language.words_of("x²y ab½ Ⅷ Été3İ") == ["x", "y", "ab", "été", "i"]


# ---- decontamination ---------------------------------------------------------------------


def test_leaks_equal_brute_force_in_any_block_size(spark, docs, benchmark):
    for d, items in ((docs, benchmark), (spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))):
        want = []
        for i in items.collect():
            own = plain_shingles(i["text"], 5)
            for r in d.collect():
                shared = len(own & plain_shingles(r["text"], len((i["text"] or "").split())))
                if own and shared >= 0.8 * len(own):
                    want.append((r["doc_id"], i["item_id"], shared, len(own)))
        for size in (decontaminate.BLOCK_BYTES, 300):
            got = [(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.leaks(d, items, block_bytes=size).collect()]
            assert want and sorted(map(repr, got)) == sorted(map(repr, want))
        kept = decontaminate.clean(d, items)
        assert kept.columns == d.columns and kept.count() == d.count() - sum(any((r["doc_id"], r["text"]) == (x[0], r["text"]) and leaky(r["text"], items) for x in want) for r in d.collect())


def plain_shingles(text, n):
    """Runs of five words, or of as many as a shorter item has."""
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    n = min(5, n, len(words) if n == 5 and len(words) < 5 else n)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words and n else set()


def leaky(text, items):
    for i in items.collect():
        own = plain_shingles(i["text"], 5)
        if own and len(own & plain_shingles(text, len((i["text"] or "").split()))) >= 0.8 * len(own):
            return True
    return False


def test_short_items_are_found_inside_long_texts():
    block = decontaminate.ItemBlock([(1, "Forty two"), (2, "yes"), (3, "a b c d e f"), (4, "three words here")], 0.8)
    found = lambda t: [block.ids[i] for i, _, _ in block.matches(t)]
    assert found("what is it? " * 500 + "it is forty  TWO, or so " * 3) == []
    assert found("what is it? " * 500 + "it is forty  TWO or so " * 3) == [1]
    assert found("yes") == [2] and found("well YES\nthree words\there") == [2, 4] and found("forty") == []


# ---- line dedup --------------------------------------------------------------------------


def test_boilerplate_lines_go_and_copies_stay(spark):
    banner, rows = "Accept all cookies to go on reading", []
    for i in range(12):
        rows.append((i, f"first line of page {i} is long\n  {banner}\nlast line of page {i}, also long", "en", f"site{i % 6}", i))
    rows += [(100 + i, "a text that was copied in full\nand has two long lines", "en", f"site{i}", i) for i in range(6)]
    rows += [(200, None, "en", None, 0), (201, "", "en", "site1", 0), (None, banner, "en", "site2", 0)]
    rows += [(300 + i, f"only four sites hold the next line {i}\nthis line is on four sites only\nand something else here {i}", "en", f"site{i}", 0) for i in range(4)]
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines long")).collect()}
    assert all(banner not in got[i]["text"] and got[i]["n_removed"] == 1 and got[i]["n_lines_"] == 3 for i in range(12))
    assert all(got[100 + i]["n_removed"] == 0 for i in range(6)) and (got[None]["text"], got[None]["n_removed"]) == ("", 1)
    assert got[200]["text"] is None and got[201]["text"] == "" and all(got[300 + i]["n_removed"] == 0 for i in range(4))


def plain_boilerplate(rows, least=16):
    sites, texts = {}, {}
    for _, text, source in rows:
        for x in (text or "").split("\n"):
            sites.setdefault(x.strip(" \t\x0b\x0c\r"), set()).add(source)
            texts.setdefault(x.strip(" \t\x0b\x0c\r"), set()).add(text)
    return {x for x in sites if x and min(len(sites[x]), len(texts[x])) >= (5 if len(x) >= least else 10)}


def test_line_dedup_equals_a_plain_count(spark, docs):
    r = random.Random(4)
    lines = [f"line {k} " + "x" * r.randrange(0, 30) for k in range(60)] + ["a", " b ", "", "\t", "É\x0b", "a" * 16]
    rows = [(r.choice([None, r.randrange(40)]), r.choice([None, "", "\n".join(r.choice(lines[: r.choice([9, 66])]) for _ in range(r.randrange(0, 9)))]), r.choice([None, *"abcdefghijkl"])) for _ in range(220)]
    rows += rows[:5] + [(900 + k, "\n".join(r.choice(lines) for _ in range(3000)), "z") for k in range(3)]
    for some in (rows, [(x["doc_id"], x["text"], x["source"]) for x in docs.collect()]):
        gone = plain_boilerplate(some)
        keep = lambda t: [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r") not in gone]
        want = [(d, None, 0, 0) if t is None else (d, "\n".join(keep(t)), len(t.split("\n")), len(t.split("\n")) - len(keep(t))) for d, t, _ in some]
        got = line_dedup.remove_boilerplate(spark.createDataFrame(some, "doc_id long, text string, source string")).select("doc_id", "text", "n_lines", "n_removed")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_lines_of_many_near_copies_stay(spark):
    r = random.Random(21)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    article, banner = [say(12) for _ in range(30)], [say(8) for _ in range(4)]
    rows = []
    for i in range(150):
        own = list(article)
        own[r.randrange(30)] = say(12)
        rows.append((i, "\n".join(own), f"s{i % 40}"))
    rows += [(1000 + i, "\n".join([banner[0], say(12), *banner[1:]]), f"s{i % 20}") for i in range(60)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[d] == t for d, t, _ in rows if d < 1000)
    assert all(got[d] == t.split("\n")[1] for d, t, _ in rows if d >= 1000)


def test_boilerplate_goes_from_short_pages_and_copied_texts_stay(spark):
    r, banner = random.Random(14), "Accept all cookies to go on reading, or leave this page\nAll rights reserved by the owners"
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{say(40)}\n{banner}\nSign in.\n{say(9)}", f"site{i % 12}") for i in range(24)]
    rows += [(100 + i, f"own {i}\n{banner}\nSign in.", f"site{i}") for i in range(3)] + [(None, banner, "site4")]
    article = "\n".join(say(9) for _ in range(20))
    rows += [(200 + i, article if i < 3 else f"{article}\n{say(3)}", f"site{i}") for i in range(6)]
    rows += [(300 + i, f"{say(30)}\nOn six.", f"site{i}") for i in range(6)] + [(400, None, None), (401, "\n \n", "site1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x["text"] for x in line_dedup.without_boilerplate(docs).collect()}
    assert len(got) == len(rows) and all(not set(banner.split("\n") + ["Sign in."]) & set((t or "").split("\n")) for t in got.values())
    assert got[None] == "" and [got[100 + i] for i in range(3)] == ["own 0", "own 1", "own 2"]
    assert all(got[d] == t for d, t, _ in rows if d and d >= 200)


def test_near_threshold_lines_are_counted_exactly(spark):
    lines = spark.range(2000).select((F.col("id") % 7).alias("line"), F.concat(F.lit("s"), F.least(F.col("id") % 11, F.col("id") % 7).cast("string")).alias("site"), F.col("id").alias("text_key"), F.lit(False).alias("short"))
    want = {r[0] for r in lines.groupBy("line").agg(F.countDistinct("site").alias("n")).where("n >= 5").collect()}
    assert {r[0] for r in line_dedup.boilerplate(lines, sites=5, log_k=4).collect()} == want


# ---- SimHash -----------------------------------------------------------------------------


def plain_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_brute_force(spark, docs):
    for table in (docs, spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = table.collect()
        prints = [plain_fingerprint(r["text"]) for r in rows]
        group = plain_components(prints, 3)
        low = {}
        for r, g in zip(rows, group):
            if r["doc_id"] is not None:
                low[g] = min(low.get(g, 1 << 62), r["doc_id"])
        want = Counter((r["doc_id"], f"{p:016x}", low.get(g)) for r, p, g in zip(rows, prints, group))
        got = simhash.grouped(table, 3, 3).select("doc_id", simhash.hexadecimal(F.col("v")).alias("f"), "component_id").collect()
        assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_roots_equal_plain_distances(radius):
    r = np.random.default_rng(radius)
    centre = r.integers(0, 1 << 63, size=6, dtype=np.uint64)
    prints = np.array([int(c) ^ sum(1 << int(b) for b in r.integers(0, 64, size=r.integers(0, 6))) for c in r.choice(centre, size=300)], dtype=np.uint64)
    group = np.sort(r.integers(0, 4, size=300))
    got = simhash.roots(prints[:, None], group, radius)
    for g in range(4):
        some = np.flatnonzero(group == g)
        want = plain_components([int(p) for p in prints[some]], radius)
        assert len(set(zip(want, got[some]))) == len(set(want)) == len(set(got[some]))


def test_long_runs_are_dealt_in_chunks(spark):
    r = random.Random(4)
    prints = sorted({(1 << 40) ^ sum(1 << r.randrange(64) for _ in range(r.randrange(1, 4))) for _ in range(200)})
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "v long").withColumn("fp", F.array("v")).withColumn("keys", F.array(F.lit(1)))
    stars = {r["a"]: r["b"] for r in simhash.components(simhash.links(table, 3, run=16)).collect()}
    got = [stars.get(v, v) for v in (p - (1 << 64) if p >> 63 else p for p in prints)]
    want = plain_components(prints, 3)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_near_copies_are_caught_and_others_left_alone(spark, docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs.where("doc_id is not null")).collect()}
    assert got[7] == got[8] == got[9] == got[10] and got[6] == got[18] == 6
    assert len({got[i] for i in (4, 5, 6, 7, 13, 14)}) == 6
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None not in ids and 7 in ids and 8 not in ids and 9 not in ids and Counter(ids)[3] == 2


def shingles_of(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_repeated_lines_do_not_hide_a_copy(spark):
    r = random.Random(11)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    texts = []
    for n in (3, 10, 40):
        text, line = say(200), say(14)
        texts += [f"{text}\n{line}", f"{text}\n" + "\n".join([line] * (n + 1))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
    h = simhash.shingle_set(texts[5], 5)
    assert len(h) == len(shingles_of(texts[5])) and simhash.wide_print(" ".join(["same few words over and"] * 30), 5)[0] == simhash.wide_print(" ".join(["same few words over and"] * 20), 5)[0]


def nearby(r, n, similarity_of):
    """A text of n words and one with so many words replaced one by one that the similarity is just what `similarity_of` allows."""
    own = [f"w{r.randrange(10**7)}" for _ in range(n)]
    other = list(own)
    for at in r.sample(range(n), n):
        changed = other[:at] + [f"x{r.randrange(10**7)}"] + other[at + 1 :]
        if not similarity_of(len(shingles_of(" ".join(own)) & shingles_of(" ".join(changed))) / len(shingles_of(" ".join(own)) | shingles_of(" ".join(changed)))):
            break
        other = changed
    return " ".join(own), " ".join(other)


def test_near_copies_equal_exact_similarity(spark):
    r, rows = random.Random(12), []
    for k in range(60):
        n = r.randrange(60, 400)
        rows += nearby(r, n, lambda j: j >= 0.8) if k % 2 else nearby(r, n, lambda j: j >= 0.72)
    same = " ".join(f"w{i}" for i in range(24))  # 16 of 20 shingles shared by two texts of 18: a similarity of just 0.8
    rows += [same.rsplit(" ", 4)[0] + " a b", same.rsplit(" ", 4)[0] + " c d"]
    sets = [shingles_of(t) for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert 31 <= len(rows) - len(set(root)) < 61
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_copies(table).collect()} == dict(enumerate(root))
    assert {x["doc_id"] for x in simhash.one_of_each(table).collect()} == set(root)


@pytest.mark.parametrize("group, shingles", [(simhash.GROUP, simhash.GROUP_SHINGLES), (4, 1 << 20), (1000, 900)])
def test_large_groups_of_candidates_are_compared_whole(spark, group, shingles):
    r, words = random.Random(13), [f"w{i}" for i in range(120)]
    texts = [" ".join(f"x{r.randrange(10**6)}" if r.random() < 0.03 else w for w in words) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    prints = docs.distinct().select("doc_id", "text_hash", simhash.wide_prints(F.col("text"), 5).alias("p")).select("doc_id", "text_hash", "p.*").withColumn("keys", F.array(F.lit(1)))
    got = {frozenset((x["a"], x["b"])) for x in simhash.similar_links(docs, prints, 5, 0.8, group, shingles).collect()}
    v, sets = [simhash.wide_print(t, 5)[0] for t in texts], [shingles_of(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    groups = {i: {i} for i in range(40)}
    for i in range(40):
        for j in range(i):
            if alike(i, j) and groups[i] is not groups[j]:
                groups[i] |= groups[j]
                for k in groups[j]:
                    groups[k] = groups[i]
    reached = {x: {x} for x in v}
    for a, b in map(tuple, got):
        if reached[a] is not reached[b]:
            reached[a] |= reached[b]
            for k in reached[b]:
                reached[k] = reached[a]
    assert all({v[j] for j in groups[i]} == reached[v[i]] for i in range(40)) and 1 < len({id(x) for x in groups.values()}) < 40


# ---- BPE ---------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs):
    library = Tokenizer.from_file(WORD_BPE)
    table = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    want = Counter()
    for r in table.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(table, WORD_BPE).collect())) == want
    both = docs.select("text", bpe.encoded(spark, F.col("text"), WORD_BPE).alias("ids")).withColumn("back", bpe.decoded(spark, F.col("ids"), WORD_BPE)).collect()
    for r in both:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["back"] == library.decode(r["ids"], skip_special_tokens=False)


def test_token_table_in_blocks(spark, docs, monkeypatch):
    library = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], r["labels"], len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    for block in (1, 5000, bpe.BLOCK):
        monkeypatch.setattr(bpe, "BLOCK", block)
        rows = bpe.token_table(docs, WORD_BPE, carried=("doc_id", "labels"), kept=50).collect()
        assert Counter((r["doc_id"], r["labels"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert bpe.token_table(docs.limit(0), WORD_BPE).collect() == []


def test_fragments_never_cut_a_token():
    with open(WORD_BPE, encoding="utf-8") as f:
        own = bpe.ForcedBoundaryBPE(f.read())
    assert all(len(own.fragments(t.removesuffix("</w>"))) == 1 for t in list(own.vocab)[::50])
    long = "".join(random.Random(3).choice("etaoin") for _ in range(400))
    assert own._scan(list(long)) == own._queue(list(long))


# ---- suffix arrays -----------------------------------------------------------------------


@pytest.mark.parametrize("memory", [1 << 20, 40])
def test_induced_sorting_equals_plain_sorting(memory):
    r = random.Random(memory)
    for _ in range(40):
        symbols = r.choice([1, 2, 5])
        part = [r.randrange(1, symbols + 1) for _ in range(r.randrange(60))]
        text = np.array(part + [r.randrange(1, symbols + 1) for _ in range(r.randrange(60))] + part + [0], dtype=np.uint16)
        places, common = suffixes.suffix_array(text, symbols + 1, 50, memory)
        cut = lambda p: text[p : p + 50].tolist()  # noqa: E731, B023
        assert sorted(places.tolist()) == list(range(len(text)))
        for a, b, n in zip(places, places[1:], common[1:]):
            x, y = cut(a), cut(b)
            assert x <= y and n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def removed_plainly(rows):
    first, out = {}, []
    for r in rows:
        b, d = (r["text"] or "").encode(), math.inf if r["doc_id"] is None else r["doc_id"]
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], math.inf), d)
    for r in rows:
        b, d = (r["text"] or "").encode(), math.inf if r["doc_id"] is None else r["doc_id"]
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((r["doc_id"], len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_bytes_equal_brute_force(spark, docs):
    for table in (docs, spark.read.parquet(f"{SMALL}/documents.parquet")):
        want = Counter(removed_plainly(table.collect()))
        for most in (suffix_dedup.MOST, 1):  # with one content per shard all strings of common minimizers are told one by one
            got = suffix_dedup.remove_repeats(table, most=most).drop("kept").collect()
            assert Counter(map(tuple, got)) == want


# ---- token counts ------------------------------------------------------------------------


def longest_first(word, pieces):
    left, n = token_counts.MARK + word, 0
    while left:
        size = next((k for k in range(len(left), 0, -1) if left[:k] in pieces), 0)
        if not size:
            return 1, 1
        left, n = left[size:], n + 1
    return n, 0


def test_token_counts_equal_greedy_matching(spark, docs):
    with open(PIECES, "rb") as f:
        pieces = set(token_counts.pieces_of(f.read()))
    table = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    want = Counter()
    for r in table.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        found = [longest_first(w, pieces) for w in words]
        want[r["doc_id"], len(words), sum(n for n, _ in found), sum(u for _, u in found)] += 1
    assert Counter(map(tuple, token_counts.token_counts(table, PIECES).collect())) == want


def test_automaton_on_vocabularies_with_gaps():
    r = random.Random(9)
    for _ in range(50):
        pieces = {token_counts.MARK} | {"".join(r.choice("ab▁") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 9))}
        own = token_counts.LongestMatch(sorted(pieces))
        for _ in range(40):
            word = "".join(r.choice("abc") for _ in range(r.randrange(0, 9)))
            assert own.count(word) == longest_first(word, pieces), (pieces, word)


# ---- language ----------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces, shares = ["▁", "▁a", "a", "ab", "b", "ba", "aba"], np.array([[0.1, 0.2], [0.2, 0.1], [0.2, 0.2], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.1, 0.1]])
    model = language.Unigrams(pieces, shares)

    def total(s):
        if not s:
            return np.ones(2)
        out = sum((shares[pieces.index(s[:k])] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces), np.zeros(2))
        return out + (language.UNKNOWN * total(s[1:]) if s[0] not in pieces else 0)

    words = ["aba", "a", "bbb", "abacab", "ab" * 12]
    assert np.allclose(np.exp(model.log_probabilities(words)), [total("▁" + w) for w in words])
    long = model.log_probabilities(["ab" * 5000])
    assert np.isfinite(long).all() and (long < -5000).all()
    into = np.zeros((len(pieces) + 1, 2))
    model.expected(["aba"], np.ones((1, 2)), into)
    assert np.allclose((into[:-1] * np.array([len(p) for p in pieces])[:, None]).sum(axis=0), 4)


def test_language_holds_out_and_is_accurate(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(table, PIECES).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    awkward_rows = {r["doc_id"]: r for r in language.identify(docs, PIECES).collect()}
    assert all(awkward_rows[i]["lang_pred"] == "und" and awkward_rows[i]["score"] == 0 for i in (0, 1, 2))
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


# ---- sharding ----------------------------------------------------------------------------


def test_sharding_balances_and_numbers_without_gaps(spark, docs):
    for table, n in ((docs, 24), (docs, 5), (spark.read.parquet(f"{SMALL}/documents.parquet"), 24)):
        rows = sharding.assign(table, n).collect()
        counts = Counter(r["shard"] for r in rows)
        assert len(rows) == table.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1
        assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(c)) for s, c in counts.items())
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_sharding_equals_the_ring_key_by_key():
    r = random.Random(6)
    for n, total in ((3, 50), (5, 200)):
        keys = sorted(r.randrange(-(1 << 63), 1 << 63) for _ in range(total))
        nodes = sharding.ring(n, 8)
        positions = [p for p, _ in nodes]
        arcs = [int(np.searchsorted(positions, k)) % len(nodes) for k in keys]
        order = sorted(range(total), key=lambda i: (arcs[i], keys[i]))
        runs = sharding.lay_out(Counter(arcs), [s for _, s in nodes], sharding.quotas(total, n))
        rank, got, seen = {}, {}, Counter()
        for i in order:
            rank[i] = seen[arcs[i]]
            seen[arcs[i]] += 1
        for arc, first, end, shard, _ in runs:
            got |= {i: shard for i in order if arcs[i] == arc and first <= rank[i] < end}
        assert [got[i] for i in range(total)] == sharding.shard_one_by_one(keys, n, 8)


# ---- empty tables ------------------------------------------------------------------------


def test_empty_tables_give_empty_results(spark, empty, benchmark):
    none = spark.createDataFrame([], "item_id long, text string")
    results = [
        licenses.scan_notices(empty), quality.judge(empty), decontaminate.leaks(empty, benchmark), decontaminate.leaks(empty, none), line_dedup.remove_boilerplate(empty),
        simhash.grouped(empty, 3, 3), simhash.near_copies(empty), simhash.one_of_each(empty), bpe.round_trip(empty, WORD_BPE), suffix_dedup.remove_repeats(empty),
        token_counts.token_counts(empty, PIECES), language.identify(empty, PIECES), sharding.assign(empty),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    assert decontaminate.clean(empty, none).columns == empty.columns
