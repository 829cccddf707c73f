"""Incremental decision tree from mergeable node statistics (split test by the Hoeffding bound; Domingos & Hulten, 2000).

Everything a node knows is a table of counts (node, feature, bin, class), and counts of several batches add up. A node splits
where the best feature's gain beats the second best's by more than the Hoeffding bound for the rows seen, or where the bound is
so small that it is a tie. Learning more means routing the new rows down the tree, adding their counts to every node on the way,
and testing again from the root; only below a node whose best split has changed are the earlier rows counted anew. So the tree
is that of all rows so far, whatever batches they came in and in what order.

Rows never meet Python: routing is a CASE over the nodes of a level, counting is a grouped aggregation with partial counts in
every task, gains are windows over the counts. What the driver sees is one row per node of a level.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.checks import BOUND_COLUMNS, LEAKAGE_COLUMNS, leakage_guard
from tidegauge.operators.models import Scorer
from tidegauge.session import materialise

#: Bins of a feature: normalised values from LOW on, each WIDTH wide; the first and the last are open.
LOW, WIDTH, BINS = -4.0, 0.25, 32

#: A node is the way to it: (feature, last bin that goes left, whether this way goes left) from the root on.
Path = tuple[tuple[str, int, bool], ...]


@dataclass(frozen=True)
class Settings:
    features: tuple[str, ...]
    label: str = "label"
    depth: int = 4
    grace: int = 200  # rows below which a node isn't tested
    delta: float = 1e-5
    tie: float = 0.05


@dataclass
class Tree:
    settings: Settings
    splits: dict[Path, tuple[str, int]] = field(default_factory=dict)
    counts: dict[Path, tuple[int, int]] = field(default_factory=dict)  # rows and positive rows of every node
    stats: DataFrame | None = None
    rows: DataFrame | None = None
    counted_again: int = 0  # nodes whose earlier rows the last batch made count anew

    def leaves(self) -> list[Path]:
        return [p for p in self.counts if p not in self.splits]


def bin_of(c: Column) -> Column:
    return F.least(F.greatest(F.floor((c - LOW) / WIDTH), F.lit(0)), F.lit(BINS - 1)).cast("int")


def shown(path: Path) -> str:
    return "/".join(f"{f}{'<=' if left else '>'}{b}" for f, b, left in path)


def _within(path: Path) -> Column:
    tests = [(bin_of(F.col(f)) <= b) if left else (bin_of(F.col(f)) > b) for f, b, left in path]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def counted(rows: DataFrame, paths: Sequence[Path], s: Settings) -> DataFrame:
    """(node, feature, bin, y, n) of the rows that lie in one of these nodes, which are apart."""
    node = reduce(lambda c, p: c.when(_within(p), F.lit(shown(p))), paths[1:], F.when(_within(paths[0]), F.lit(shown(paths[0]))))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(F.col(f)).alias("bin")) for f in s.features])
    placed = rows.select(node.alias("node"), F.col(s.label).cast("int").alias("y"), F.explode(cells).alias("c")).where(F.col("node").isNotNull())
    return placed.groupBy("node", F.col("c.feature").alias("feature"), F.col("c.bin").alias("bin"), "y").agg(F.count("*").alias("n"))


def _gini(positive: Column, n: Column) -> Column:
    p = F.try_divide(positive, n)
    return F.coalesce(F.lit(2.0) * p * (F.lit(1.0) - p), F.lit(0.0))


def gains(stats: DataFrame) -> DataFrame:
    """(node, feature, bin, gain, n, positive): the loss of impurity if the bins up to `bin` go left."""
    bins = stats.groupBy("node", "feature", "bin").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("y")).alias("k1"))
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("node", "feature")
    d = bins.select("node", "feature", "bin", *[F.sum(c).over(w).alias(n) for c, w, n in (("k", upto, "l"), ("k1", upto, "l1"), ("k", whole, "n"), ("k1", whole, "positive"))])
    left, right = F.col("l"), F.col("n") - F.col("l")
    apart = left / F.col("n") * _gini(F.col("l1"), left) + right / F.col("n") * _gini(F.col("positive") - F.col("l1"), right)
    gain = F.when(right > 0, _gini(F.col("positive"), F.col("n")) - apart).otherwise(F.lit(0.0))
    return d.select("node", "feature", "bin", gain.alias("gain"), "n", "positive")


def tested(stats: DataFrame, s: Settings) -> DataFrame:
    """One row per node: its best split, the best of any other feature, the bound, and whether it splits."""
    order = Window.partitionBy("node", "feature").orderBy(F.desc("gain"), "bin")
    best = gains(stats).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("gain"), "feature")))
    one = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    out = ranked.groupBy("node").agg(
        one("feature", 1).alias("feature"), one("bin", 1).alias("bin"), one("gain", 1).alias("gain"), F.coalesce(one("gain", 2), F.lit(0.0)).alias("second"),
        F.max("n").alias("n"), F.max("positive").alias("positive"),
    )
    # Gini impurity of two classes lies in [0, 1/2].
    bound = F.sqrt(F.lit(0.25 * math.log(1.0 / s.delta) / 2.0) / F.col("n"))
    ahead = (F.col("gain") - F.col("second") > bound) | (bound < s.tie)
    return out.withColumn("bound", bound).withColumn("splits", (F.col("n") >= s.grace) & (F.col("gain") > 0) & ahead)


def learn(tree: Tree, batch: DataFrame) -> Tree:
    """The tree of all rows so far and those of the batch; complete rows only, features free of leakage columns."""
    s = tree.settings
    leakage_guard(s.features, (*LEAKAGE_COLUMNS, *BOUND_COLUMNS, s.label))
    batch = materialise(batch.select(*s.features, s.label).dropna(), "batch")
    rows = batch if tree.rows is None else tree.rows.unionByName(batch)
    out, again = Tree(s, rows=rows), 0
    level: list[Path] = [()]
    kept: list[DataFrame] = []
    while level:
        known, fresh = [p for p in level if p in tree.counts], [p for p in level if p not in tree.counts]
        parts = []
        if known:
            parts += [tree.stats.where(F.col("node").isin([shown(p) for p in known])), counted(batch, known, s)]
        if fresh:
            parts.append(counted(rows, fresh, s))
            again += len(fresh) if tree.rows is not None else 0
        stats = reduce(DataFrame.unionByName, parts).groupBy("node", "feature", "bin", "y").agg(F.sum("n").alias("n"))
        stats = materialise(stats, "nodes")
        kept.append(stats)
        found = {r["node"]: r for r in tested(stats, s).collect()}  # one row per node of the level
        below: list[Path] = []
        for p in level:
            r = found.get(shown(p))
            out.counts[p] = (r["n"], r["positive"]) if r else (0, 0)
            if r and r["splits"] and len(p) < s.depth:
                out.splits[p] = (r["feature"], r["bin"])
                below += [(*p, (r["feature"], r["bin"], True)), (*p, (r["feature"], r["bin"], False))]
        level = below
    out.stats, out.counted_again = reduce(DataFrame.unionByName, kept), again
    return out


def scorer(tree: Tree) -> Scorer:
    """Adds p0 and p1 from the leaf that a row falls into; a feature that is missing gives the root's share."""
    share = lambda p: (tree.counts[p][1] + 1.0) / (tree.counts[p][0] + 2.0)
    p1 = reduce(lambda c, p: c.when(_within(p), F.lit(share(p))), tree.leaves(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(share(())))
    return lambda df: df.select("*", (F.lit(1.0) - p1).alias("p0"), p1.alias("p1"))


def node_table(tree: Tree, df: DataFrame) -> DataFrame:
    """One row per node: its way, depth, rows, positive rows, and the split if it has one (`df` gives the session)."""
    rows = [(shown(p), len(p), n, k, *tree.splits.get(p, (None, None))) for p, (n, k) in tree.counts.items()]
    return df.sparkSession.createDataFrame(rows, "node string, depth int, n long, positive long, feature string, bin int")
