"""Line dedup by distinct-site spread.

A line that stands on many sites (sources) is boilerplate, unless it does so only because whole texts were copied: it has
to stand in as many different texts, too. Per line hash, HyperLogLog sketches of its sites and of its texts are built in every
task and merged by aggregation. Sketches err by a few percent, so lines whose estimate is near the threshold get exact distinct
counts; only the others are decided by the sketch. Boilerplate lines then go from every document, however much of it they are.

`without_boilerplate`, the pipeline's stage, also lets near copies of one text count as one site. Only documents that are mostly
boilerplate by the plain rule can be such copies; they meet under their smallest boilerplate line, and those whose shingles are
like those of the smallest of them count as its copies. Those that stood apart because a copy lost that line meet once more under
the largest one.

DataFrame functions only. Lines are taken apart once, into narrow rows, and written; whole texts move in a single join, and only
those that lose a line (a table of a fixed number of buckets, small enough to broadcast, lets the others pass). A line as common
as a third of all rows meets in partial sketches; copies of a text share one row of flags.

Lines are split at line feeds, compared without ASCII white space around them, and blank ones don't count. A line under
`least_chars` characters must stand on more sites. A null source is a site of its own. Null text stays null, empty text empty;
a text of boilerplate only comes out empty. Repeated rows and ids and null ids do no harm; other columns are passed on, whatever
their names. An empty table gives an empty one. The work is linear in the lines of a text, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, split_by
from tidegauge.session import materialise

#: Sites from which on a line is boilerplate; characters that a line needs for that.
SITES, LEAST_CHARS = 5, 16
#: Sites from which on a shorter line is boilerplate.
SHORT_SITES = 10
#: Size of the sketches (2^LOG_K registers, standard error about 1.04 / sqrt(2^LOG_K)).
LOG_K = 12
#: Share of the threshold around it within which an estimate isn't trusted: more than six standard errors.
NEAR = 0.1
#: Words of a shingle, smallest hashes that stand for a text, and their estimated similarity from which on it is a copy.
WIDTH, SKETCH, ALIKE = 5, 256, 0.6


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def lines_of(df: DataFrame, text_col: str = "text", source_col: str = "source", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(text_key, site, at, line, short, letters) of every line: its place, its hash (null: blank), whether it has fewer characters."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("none")).alias("site")
    rows = df.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text_key"), site, F.posexplode(F.split(text_col, "\n")).alias("at", "x"))
    rows = rows.select("text_key", "site", "at", stripped(F.col("x")).alias("x"))
    judged = F.length("x") > 0
    letters = F.length(F.translate("x", " \t\x0b\x0c\r", "")).alias("letters")
    return rows.select("text_key", "site", "at", F.when(judged, F.xxhash64("x")).alias("line"), (F.length("x") < least_chars).alias("short"), letters)


def boilerplate(lines: DataFrame, sites: int = SITES, short_sites: int = SHORT_SITES, near: float = NEAR, log_k: int = LOG_K) -> DataFrame:
    """Hashes of the lines on as many distinct sites and in as many distinct texts as they need; `lines` is read twice."""
    lines = lines.where(F.col("line").isNotNull())
    about = [F.hll_sketch_estimate(F.hll_sketch_agg(c, log_k)) for c in ("site", "text_key")]
    needs = F.when(F.max("short"), F.lit(short_sites)).otherwise(F.lit(sites))
    spread = lines.groupBy("line").agg(F.least(*about).alias("about"), needs.alias("needs"))
    band = F.greatest(F.lit(1), F.floor(F.col("needs") * near))
    far = spread.where(F.col("about") > F.col("needs") + band).select("line")
    unsure = spread.where(F.abs(F.col("about") - F.col("needs")) <= band).select("line", "needs")
    some = lines.select("line", "site", "text_key").join(unsure.select("line"), "line", "left_semi")
    exact = None
    for c in ("site", "text_key"):
        n = some.select("line", c).distinct().groupBy("line").agg(F.count("*").alias(f"n_{c}"))
        exact = n if exact is None else exact.join(n, "line")
    exact = exact.join(unsure, "line").where(F.least("n_site", "n_text_key") >= F.col("needs")).select("line")
    return far.unionByName(exact)


def _without(df: DataFrame, lines: DataFrame, common: DataFrame, text_col: str, counts: bool) -> DataFrame:
    """`df` without the lines of `common`; with `counts` also how many lines there were and went."""
    bad = lines.join(common.withColumn("bad", F.lit(True)), "line", "left_semi").select("text_key").distinct()
    bad = materialise(bad, "texts")
    known = common.withColumn("bad", F.lit(True))
    told = lines.select("text_key", "at", "line").distinct().join(bad, "text_key", "left_semi").join(known, "line", "left")
    flags = told.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bad", F.lit(False)).alias("bad")))).alias("told"))
    key, gone, hit = (free_name(df, x) for x in ("__text_key", "__gone", "__hit"))
    flags = flags.select(F.col("text_key").alias(key), F.transform("told", lambda x: x["bad"]).alias(gone))
    own, rest = split_by(df.withColumn(key, F.xxhash64(text_col)), [F.col(key)], bad, ["text_key"])
    own = own.join(flags, key, "left")
    split = F.split(text_col, "\n")
    lost = F.col(text_col).isNotNull() & F.col(gone).isNotNull()
    own = own.withColumn(hit, F.when(lost, F.filter(split, lambda x, i: ~F.get(F.col(gone), i))))
    text = F.when(F.col(hit).isNotNull(), F.array_join(hit, "\n")).otherwise(F.col(text_col))
    n_lines, n_removed = free_name(df, "n_lines"), free_name(df, "n_removed")
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long").alias(n_lines)
    went = F.coalesce(F.size(split) - F.size(hit), F.lit(0)).cast("long").alias(n_removed)
    own = own.select(*[(text if c == text_col else F.col(c)).alias(c) for c in df.columns], *([size, went] if counts else []))
    rest = rest.select(*df.columns, *([size, F.lit(0).cast("long").alias(n_removed)] if counts else []))
    return own.unionByName(rest)


def remove_boilerplate(
    df: DataFrame, sites: int = SITES, short_sites: int = SHORT_SITES, least_chars: int = LEAST_CHARS, text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """`df` with the text cleaned, and the lines before and removed as `n_lines` and `n_removed` (free names, if taken)."""
    lines = materialise(lines_of(df, text_col, source_col, least_chars), "lines")
    common = materialise(boilerplate(lines, sites, short_sites), "common")
    return _without(df, lines, common, text_col, True)


def sketches_of(texts: DataFrame) -> DataFrame:
    """(text_key, sketch): the smallest hashes of each text's distinct shingles; all of them, if there are fewer."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Words are a column of their own: inside a lambda they would be split anew for every shingle.
    words = texts.select("text_key", F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WIDTH - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, WIDTH)))
    return words.select("text_key", F.slice(F.sort_array(F.array_distinct(grams)), 1, SKETCH).alias("sketch"))


def _alike(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: of the smallest hashes of both together, the share that both have."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)


def _led(members: DataFrame, by: str) -> DataFrame:
    """(text_key, leader): the smallest text under the same line, if the text is like it; else the text itself."""
    leaders = members.groupBy(by).agg(F.min(F.struct("text_key", "sketch")).alias("l")).select(by, "l.*")
    leaders = leaders.select(by, F.col("text_key").alias("leader"), F.col("sketch").alias("its"))
    alike = _alike(F.col("sketch"), F.col("its")) >= ALIKE
    return members.join(leaders, by).select("text_key", F.when(alike, F.col("leader")).otherwise(F.col("text_key")).alias("leader"))


def copies(df: DataFrame, letters: DataFrame, text_col: str) -> DataFrame:
    """(text_key, copy): texts that are mostly boilerplate, and the text each of them is a copy of (or itself).

    `letters`: text_key, mostly (by letters), smallest and largest line of boilerplate.
    """
    mostly = materialise(letters.where("mostly").select("text_key", "low", "high"), "mostly")
    texts = df.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    some, _ = split_by(texts, [F.col("text_key")], mostly, ["text_key"])
    # Copies of a text have the same sketch: any of them will do.
    sketches = sketches_of(some).groupBy("text_key").agg(F.first("sketch").alias("sketch"))
    members = materialise(mostly.join(sketches, "text_key"), "sketches")
    first = materialise(_led(members, "low"), "led")
    leaders = members.join(first.select(F.col("leader").alias("text_key")).distinct(), "text_key", "left_semi")
    second = _led(leaders, "high").select(F.col("text_key").alias("leader"), F.col("leader").alias("copy"))
    return first.join(second, "leader").select("text_key", "copy")


def without_boilerplate(
    df: DataFrame, sites: int = SITES, short_sites: int = SHORT_SITES, least_chars: int = LEAST_CHARS, text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """`df` without the lines that stand on enough sites, where near copies of a text count as one site together."""
    lines = materialise(lines_of(df, text_col, source_col, least_chars), "lines")
    common = materialise(boilerplate(lines, sites, short_sites), "common")
    marked = lines.select("text_key", "at", "line", "letters").distinct().join(common.withColumn("bad", F.lit(True)), "line", "left")
    bad = F.coalesce("bad", F.lit(False))
    letters = marked.groupBy("text_key").agg(
        (F.sum(F.when(bad, F.col("letters")).otherwise(0)) * 2 > F.sum("letters")).alias("mostly"),
        F.min(F.when(bad, F.col("line"))).alias("low"), F.max(F.when(bad, F.col("line"))).alias("high"),
    )
    held = materialise(lines.join(common, "line", "left_semi").select("text_key", "line", "site", "short").distinct(), "held")
    groups = materialise(copies(df, letters, text_col), "copies")
    grouped = held.join(groups, "text_key")
    # One of its sites and of its texts stands for a group; the site is picked by hash: the smallest would be the same for many.
    one = materialise(grouped.groupBy("copy").agg(F.min_by("site", F.xxhash64("site", "copy")).alias("one")), "sites")
    recounted = held.join(groups.join(one, "copy"), "text_key", "left")
    recounted = recounted.select("line", "short", F.coalesce("one", "site").alias("site"), F.coalesce("copy", "text_key").alias("text_key"))
    # Sites and texts were counted apart above; copies of one text on one site count once in both.
    settled = materialise(boilerplate(materialise(recounted.distinct(), "recounted"), sites, short_sites), "settled")
    return _without(df, lines, settled, text_col, False)
