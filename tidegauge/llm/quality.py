"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets a few whole-number measures. Their distributions are sketched per language and source: a value is
counted in a bucket that keeps its six leading bits, so a sketch is a small table of counts, bucket edges are within
1/32 of the value, and sketches merge by adding counts: partial sketches of map tasks, of the sources of a language,
of the whole corpus. A threshold stands off the group's ninth decile by some times that decile's distance to the median, and
by a slack that is no more than one event in a short document; so it lies where the group's own spread puts it. Groups
with few documents borrow the sketch of their language, languages with few that of the corpus. Documents join the
thresholds of their group and are kept if no measure is outside. One repeated line, and repeated windows of 20 words, are no
sign of anything and don't enter their measures.

DataFrame functions only. A document is one row: arrays of its words never leave it, so nothing is shuffled but measures.

Null text has no words. Rows with null language or source form groups of their own. Documents that fail the base rules
are not kept and don't enter the sketches; a corpus without any other document has no thresholds and rejects nothing
more. Equal texts of one group get equal verdicts. Repeated 5-word windows are told by 64-bit hashes within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.common import SPACE_CLASS
from tidegauge.session import materialise

#: Words in a window whose repeats count.
WINDOW = 5
#: Documents that a group needs for thresholds of its own.
LEAST_GROUP = 100
#: Measure: slack, and how many times the ninth decile's distance to the median a threshold stands off that decile.
MEASURES = {
    "symbol_rate": (20, 4),
    "upper_rate": (10, 4),
    "duplicate_line_rate": (100, 4),
    "repeat_rate": (25, 4),
    "word_length": (20, 4),
}
#: Repeated lines and words of repeated windows that are not counted.
FREE_LINES, FREE_WORDS = 1, 20
#: Only the last is bounded from below too.
TWO_SIDED = ("word_length",)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the base counts and whole-number measures (per mille; hundredths of a letter)."""
    d = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines).withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    n = F.size("w")
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = F.transform(at, lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)]))
    d = d.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window.alias("windows"),
    )
    # Few documents repeat a window: the others are done after one sort of plain numbers.
    d = d.withColumn("sorted", F.array_sort("windows"))
    d = d.withColumn("repeats", F.exists(F.sequence(F.lit(1), F.greatest(F.size("sorted") - 1, F.lit(1))), lambda i: F.get("sorted", i) == F.get("sorted", i - 1)))
    pairs = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(F.col("repeats"), pairs)).drop("windows", "sorted")
    twin = F.filter("pairs", lambda e, i: (e["h"] == F.get("pairs", i - 1)["h"]) | (e["h"] == F.get("pairs", i + 1)["h"]))
    d = d.withColumn("starts", F.array_sort(F.transform(twin, lambda e: e["i"]))).drop("pairs")
    steps = F.transform("starts", lambda x, i: F.least(F.coalesce(F.get("starts", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda a, b: a + b)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts", "repeats")
    one = F.lit(1)
    share = lambda a, b, free=0: F.floor(F.greatest(F.col(a) - free, F.lit(0)) * 1000 / F.greatest(b, one)).cast("long")
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_rate"), share("n_upper", "word_chars").alias("upper_rate"), share("n_dup_lines", "n_lines", FREE_LINES).alias("duplicate_line_rate"),
        share("n_repeat_words", "n_words", FREE_WORDS).alias("repeat_rate"), F.floor(F.col("word_chars") * 100 / F.greatest("n_words", one)).cast("long").alias("word_length"),
    )


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): six leading bits of every value of the rows that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES]))
    drop = "greatest(length(bin(v)) - 6, 0)"
    return (
        rows.where(~F.col("base_failed")).select("lang", "source", values.alias("x")).select("lang", "source", "x.*")
        .groupBy("lang", "source", "measure", F.expr(f"shiftleft(shiftright(v, {drop}), {drop})").alias("bucket")).agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: buckets add up."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """A row per group: its document count and, for each measure, low and high."""
    w = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumn("up_to", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    decile = lambda q: F.min(F.when(F.col("up_to") * 10 >= F.col("total") * q, F.col("bucket")))
    each = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), *[decile(q).alias(f"d{q}") for q in (1, 5, 9)])
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    bounds = [F.max("docs").alias("docs")]
    for m, (slack, widths) in MEASURES.items():
        high = F.col("d9") + (F.col("d9") - F.col("d5")) * widths + slack
        low = F.col("d1") - (F.col("d5") - F.col("d1")) * widths - slack
        bounds.append(of(m, high).alias(f"{m}_high"))
        bounds.append((of(m, low) if m in TWO_SIDED else F.lit(None).cast("long")).alias(f"{m}_low"))
    return each.groupBy(*keys).agg(*bounds)


def thresholds(rows: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """One row per (lang, source) with bounds from the finest sketch that has enough documents."""
    own = materialise(sketch(rows), "sketch")
    bounds = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    levels = [fences(merged(own, *keys) if len(keys) < 2 else own, *keys) for keys in (("lang", "source"), ("lang",), ())]
    named = [d.select(*[F.col(k).alias(f"k{i}_{k}") for k in ("lang", "source")[: 2 - i]], F.col("docs").alias(f"docs{i}"), F.struct(*bounds).alias(f"b{i}")) for i, d in enumerate(levels)]
    groups = rows.select("lang", "source").distinct()
    t = groups.join(named[0], F.col("lang").eqNullSafe(F.col("k0_lang")) & F.col("source").eqNullSafe(F.col("k0_source")), "left")
    t = t.join(named[1], F.col("lang").eqNullSafe(F.col("k1_lang")), "left").join(F.broadcast(named[2]), F.lit(True), "left")  # the last is one row
    best = F.when(F.col("docs0") >= least, F.col("b0")).when(F.col("docs1") >= least, F.col("b1")).otherwise(F.col("b2"))
    return t.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), best.alias("b")).select("t_lang", "t_source", "b.*")


def judge(df: DataFrame, least: int = LEAST_GROUP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, kept."""
    rows = materialise(measured(df, id_col, text_col, lang_col, source_col), "measures")
    t = thresholds(rows, least)
    outside = F.lit(False)
    for m in MEASURES:
        outside |= F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
        if m in TWO_SIDED:
            outside |= F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False))
    joined = rows.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~outside).alias("kept")
    )
