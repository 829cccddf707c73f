"""The incremental tree against a plain one over all rows, whatever batches they come in."""

import math
import random

import pytest

from tidegauge.operators import trees

SCHEMA = "a double, b double, label int"


def rows_of(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.gauss(0, 1.5), r.gauss(0, 1.5)
        y = int((a > 0.7 and b > -0.4) or (a <= 0.7 and b > 1.6)) ^ (r.random() < 0.05)
        out.append((a, b, y))
    return out


def plain(rows, s):
    """Splits and counts of every node, by exhaustive search."""
    place = lambda x: min(max(math.floor((x - trees.LOW) / trees.WIDTH), 0), trees.BINS - 1)
    gini = lambda k, n: 2 * (k / n) * (1 - k / n) if n else 0.0
    splits, counts, open_ = {}, {}, [((), rows)]
    while open_:
        path, own = open_.pop()
        n, k = len(own), sum(r[2] for r in own)
        counts[path] = (n, k)
        best = []
        for at, f in enumerate(s.features):
            options = []
            for b in sorted({place(r[at]) for r in own}):
                left = [r for r in own if place(r[at]) <= b]
                l, l1 = len(left), sum(r[2] for r in left)
                gain = gini(k, n) - l / n * gini(l1, l) - (n - l) / n * gini(k - l1, n - l) if l < n else 0.0
                options.append((-gain, b))
            if options:
                best.append((*min(options), f))
        best.sort(key=lambda x: (x[0], x[2]))
        if not best or n < s.grace or len(path) >= s.depth or -best[0][0] <= 0:
            continue
        bound = math.sqrt(0.25 * math.log(1 / s.delta) / 2 / n)
        if -best[0][0] + best[1][0] > bound or bound < s.tie:
            _, b, f = best[0]
            splits[path] = (f, b)
            at = s.features.index(f)
            open_ += [((*path, (f, b, side)), [r for r in own if (place(r[at]) <= b) == side]) for side in (True, False)]
    return splits, counts


@pytest.mark.parametrize("cuts", [[], [700], [60, 300, 301, 1500]])
def test_any_batches_give_the_plain_tree(spark, cuts):
    s = trees.Settings(("a", "b"), depth=3, grace=100, delta=1e-3)
    rows = rows_of(2400, 5)
    tree = trees.Tree(s)
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        tree = trees.learn(tree, spark.createDataFrame(rows[lo:hi], SCHEMA))
    splits, counts = plain(rows, s)
    assert splits and tree.splits == splits and tree.counts == counts
    if not cuts:
        assert tree.counted_again == 0


def test_a_tree_that_stands_counts_only_the_new_rows(spark):
    s = trees.Settings(("a", "b"), depth=2, grace=100, delta=1e-3)
    first = trees.learn(trees.Tree(s), spark.createDataFrame(rows_of(2500, 6), SCHEMA))
    more = trees.learn(first, spark.createDataFrame(rows_of(200, 7), SCHEMA))
    assert more.splits == first.splits and more.counted_again == 0
    assert more.counts[()][0] == 2700


def test_scores_are_the_shares_of_the_leaves(spark):
    s = trees.Settings(("a", "b"), depth=2, grace=100, delta=1e-3)
    rows = rows_of(2000, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    tree = trees.learn(trees.Tree(s), df)
    scored = trees.scorer(tree)(df).collect()
    hits = sum((r.p1 >= 0.5) == bool(r.label) for r in scored)
    assert hits > 0.8 * len(rows) and all(abs(r.p0 + r.p1 - 1) < 1e-12 for r in scored)
    assert {round(r.p1, 9) for r in scored} <= {round((k + 1) / (n + 2), 9) for p, (n, k) in tree.counts.items() if p not in tree.splits}
    assert trees.node_table(tree, df).count() == len(tree.counts)


def test_missing_rows_empty_batches_and_leaks(spark):
    s = trees.Settings(("a", "b"), depth=2)
    tree = trees.learn(trees.Tree(s), spark.createDataFrame([(None, 1.0, 1), (1.0, 1.0, None), (0.5, 0.5, 1)], SCHEMA))
    assert tree.counts == {(): (1, 1)} and not tree.splits
    same = trees.learn(tree, spark.createDataFrame([], SCHEMA))
    assert same.counts == tree.counts
    assert trees.learn(trees.Tree(s), spark.createDataFrame([], SCHEMA)).counts == {(): (0, 0)}
    with pytest.raises(ValueError):
        trees.learn(trees.Tree(trees.Settings(("a", "label"))), spark.createDataFrame([], SCHEMA))
