"""Forests grown over partitions against trees grown by hand, and held-out groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import forest, learn
from wayfold.operators.ranking import draws


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = (r.randrange(40) for _ in range(3))
        out.append((i, "xyz"[i % 3], int(a > 28 and b < 20) if r.random() > 0.05 else r.randrange(2), float(a), float(b), float(c)))
    return out


def frame(spark, data, parts=4):
    return spark.createDataFrame(data, "k long, g string, y int, a double, b double, c double").repartition(parts)


def grow(x, y, m, depth, least, bins, seed, n_nodes, tree):
    """One tree, node by node, over all splits: {node: (feature, cut) or None, share of the label 1}."""
    w = np.array([m.sum() / (2 * max(m[y == c].sum(), 1)) for c in (0, 1)])
    out = {}

    def gini(at):
        s = np.array([(m[at] * (y[at] == c)).sum() * w[c] for c in (0, 1)])
        return (s * s).sum() / max(s.sum(), 1e-300)

    def go(node, at, level):
        sums = np.array([(m[at] * (y[at] == c)).sum() for c in (0, 1)])
        share = sums[1] * w[1] / (sums * w).sum()
        best = None
        if level < depth and (sums > 0).all():
            may = forest.chosen_features(np.array([tree * n_nodes + node]), x.shape[1], seed)[0]
            for f in np.flatnonzero(may):
                for cut in range(bins):
                    left, right = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                    gain = gini(left) + gini(right) - gini(at)
                    if m[left].sum() >= least and m[right].sum() >= least and gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut)
        out[node] = (best and best[1:], share)
        if best:
            go(2 * node + 1, at & (x[:, best[1]] <= best[2]), level + 1)
            go(2 * node + 2, at & (x[:, best[1]] > best[2]), level + 1)

    go(0, np.ones(len(y), bool), 0)
    return out


def test_trees_are_those_grown_by_hand(spark):
    data = rows(160)
    got = forest.fit(frame(spark, data), ["a", "b", "c"], "y", "k", trees=5, depth=3, bins=8)
    x = got.bins(np.array([r[3:] for r in data]))
    y, m = np.array([r[2] for r in data]), draws(np.array([r[0] for r in data]), 5)
    for tree in range(5):
        want = grow(x, y, m[:, tree], 3, 5, 8, 7, 15, tree)
        for node, (split, share) in want.items():
            assert abs(got.value[tree, node] - share) < 1e-9
            assert (got.feature[tree, node] >= 0) == (split is not None)
            if split:
                assert (got.feature[tree, node], got.bin[tree, node]) == split


def test_partitions_change_nothing(spark):
    one, many = (forest.fit(frame(spark, rows(200), p), ["a", "b"], "y", "k", trees=4, depth=4) for p in (1, 7))
    assert (one.feature == many.feature).all() and (one.bin == many.bin).all() and np.allclose(one.value, many.value)


def test_groups_are_scored_by_trees_that_have_not_seen_them(spark):
    data = frame(spark, rows(900))
    got = forest.fit(data, ["a", "b", "c"], "y", "k", group="g", trees=40, depth=5)
    scored = forest.score(data, got, "g")
    assert scored.columns == [*data.columns, "score"] and scored.count() == 900
    assert learn.ranking_measures(scored, "y", "score").first().roc_auc > 0.85
    # without the rows of a group its own trees are the same
    alone = forest.fit(data.filter("g <> 'y'"), ["a", "b", "c"], "y", "k", trees=40, depth=5, seed=7)
    assert len(alone.feature) == 40 and got.group.count("y") == 40


def test_samples_are_balanced(spark):
    data = [(i, "x", int(i % 10 == 0), float(i % 7), 0.0, 0.0) for i in range(400)]
    got = forest.fit(frame(spark, data), ["c"], "y", "k", trees=3, depth=2)
    assert np.allclose(got.value[:, 0], 0.5)  # both classes weigh the same in each tree
    assert np.allclose(forest.score(frame(spark, data), got).select("score").toPandas(), 0.5)


def test_one_class_or_no_rows(spark):
    same = frame(spark, [(i, "x", 1, float(i), 0.0, 0.0) for i in range(20)])
    assert [r.score for r in forest.score(same, forest.fit(same, ["a"], "y", "k", trees=2)).collect()] == pytest.approx([1.0] * 20)
    none = same.limit(0)
    assert forest.score(none, forest.fit(none, ["a"], "y", "k", trees=2)).count() == 0
    assert forest.score(same.select("k", "a", F.lit(5).alias("x")), forest.fit(none, ["a"], "y", "k", trees=2)).first().score == 0.5
