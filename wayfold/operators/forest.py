"""A random forest whose trees are each balanced on rows of their own, grown level by level.

How often a row is in a tree's sample is a hash of its key and the tree, so no
sample is stored or shuffled.  A level is one pass: each task adds up its rows by
tree, node, feature and bin, Spark sums these, and the best split of each node is
found where its sums meet.  All trees, and all forests of a leave-one-group-out
run, grow in the same passes.  What reaches the driver is the model.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.ranking import draws

TREES, DEPTH, LEAST_LEAF, BINS = 500, 6, 5, 32
#: Elements (rows times trees) that are worked on at a time.
AT_ONCE = 1 << 20


@dataclass
class Forest:
    """Nodes by number, the children of i at 2i + 1 and 2i + 2; a leaf has the feature -1."""

    features: list[str]
    cuts: np.ndarray  # (features, bins - 1), ascending
    feature: np.ndarray  # (trees, nodes)
    bin: np.ndarray  # a row goes left if its bin is at most this
    value: np.ndarray  # share of the label 1 in a node's weights
    group: list  # the group that each tree has not seen, None for none

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def nodes(self, bins: np.ndarray, trees: slice) -> np.ndarray:
        """The node, as far down as the trees have grown, of each row (first axis) in each tree."""
        feature, cut = self.feature[trees], self.bin[trees]
        tree = np.arange(len(feature))[None, :]
        node = np.zeros((len(bins), len(feature)), dtype=np.int64)
        row = np.arange(len(bins))[:, None]
        while True:
            f = feature[tree, node]
            inner = f >= 0
            if not inner.any():
                return node
            right = bins[row, np.maximum(f, 0)] > cut[tree, node]
            node = np.where(inner, 2 * node + 1 + right, node)

    def members(self, bins: np.ndarray, trees: slice, row: np.ndarray, tree: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
        """(row, tree, n, node) of those pairs of row and tree that have come down to nodes of a level."""
        feature, cut, n_nodes = self.feature[trees].ravel(), self.bin[trees].ravel(), self.feature.shape[1]
        flat, node = bins.ravel(), np.zeros(len(row), dtype=np.int64)
        for _ in range(level):
            at = tree * n_nodes + node
            f = feature[at]
            inner = f >= 0
            if not inner.all():
                row, tree, n, node, at, f = (v[inner] for v in (row, tree, n, node, at, f))
            node = 2 * node + 1 + (flat[row * bins.shape[1] + f] > cut[at])
        return row, tree, n, node

    def scores(self, x: np.ndarray, group: list) -> np.ndarray:
        """Mean over the trees that have not seen the row's group (over all trees, if they were grown on all groups)."""
        bins, out = self.bins(x), np.zeros(len(x))
        unseen = {g: np.array([i for i, t in enumerate(self.group) if t is None or t == g]) for g in set(group)}
        members = np.array(group, dtype=object)
        for g, trees in unseen.items():
            at = np.flatnonzero([m == g for m in members])
            if len(trees):
                one = Forest(self.features, self.cuts, self.feature[trees], self.bin[trees], self.value[trees], [])
                out[at] = one.value[np.arange(len(trees))[None, :], one.nodes(bins[at], slice(None))].mean(axis=1)
            else:
                out[at] = np.nan
        return out


def chosen_features(slot: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(slots, features): the square root of the features that each node may split on, by hash."""
    x = (slot[:, None].astype(np.uint64) * np.uint64(n) + np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    rank = np.argsort(np.argsort(x ^ (x >> np.uint64(32)), axis=1), axis=1)
    return rank < max(1, int(np.sqrt(n)))


def best_splits(slot: np.ndarray, count: np.ndarray, weight: np.ndarray, least_leaf: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature (-1 for none) and bin with the least Gini impurity of each slot.

    ``count``: (slots, features, bins, 2 classes) rows with their multiplicities;
    ``weight``: (slots, 2) what a row of each class counts.
    """
    left = np.cumsum(count, axis=2)
    right = left[:, :, -1:, :] - left
    w = weight[:, None, None, :]

    def purity(n: np.ndarray) -> np.ndarray:
        x = n * w
        whole = x.sum(axis=3)
        return (x * x).sum(axis=3) / np.maximum(whole, 1e-300)

    gain = purity(left) + purity(right) - purity(left[:, :, -1:, :])
    fits = (left.sum(axis=3) >= least_leaf) & (right.sum(axis=3) >= least_leaf) & allowed[:, :, None]
    gain = np.where(fits, gain, -1.0).reshape(len(slot), -1)
    best = gain.argmax(axis=1)
    found = gain[np.arange(len(slot)), best] > 1e-12
    return np.where(found, best // count.shape[2], -1), best % count.shape[2]


def fit(df: DataFrame, features: list[str], label: str, key: str, group: str | None = None, trees: int = TREES, depth: int = DEPTH, least_leaf: int = LEAST_LEAF, bins: int = BINS, seed: int = 7) -> Forest:
    """A forest of ``trees`` trees, or with ``group`` as many for each group, grown on all others.

    ``key`` is a whole number, ``label`` 0 or 1, features are numbers without nulls.
    Each tree draws rows with replacement and weighs its classes to equal sums.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y"), (F.col(group) if group else F.lit(None)).cast("string").alias("g"), *(F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)))
    at = [i / bins for i in range(1, bins)]
    cuts = rows.agg(*(F.percentile_approx(f"x{j}", at, 10_000).alias(f"x{j}") for j in range(len(features)))).first()
    groups = sorted(r.g for r in rows.select("g").filter("g IS NOT NULL").distinct().collect()) if group else [None]  # few by design
    n_trees, n_nodes, n = trees * len(groups), 2 ** (depth + 1) - 1, len(features)
    empty = np.full((n_trees, n_nodes), -1)
    forest = Forest(features, np.array([[*(cuts[j] or [0.0] * len(at))] for j in range(n)], dtype=float), empty, empty.copy(), np.full((n_trees, n_nodes), np.nan), [g for g in groups for _ in range(trees)])
    weight = np.ones((n_trees, 2))
    for level in range(depth + 1):
        found = _level(rows, forest, weight, level, depth, least_leaf, bins, seed)
        for r in found:
            tree, node = divmod(r.slot, n_nodes)
            if level == 0:
                whole = r.n0 + r.n1
                weight[tree] = [whole / (2 * max(c, 1)) for c in (r.n0, r.n1)]
            sums = weight[tree] * [r.n0, r.n1]
            forest.value[tree, node] = sums[1] / sums.sum() if sums.sum() else np.nan
            forest.feature[tree, node], forest.bin[tree, node] = r.feature, r.bin
    # a node without rows of its tree's sample has its parent's value
    for node in range(n_nodes):
        blank = np.isnan(forest.value[:, node])
        forest.value[blank, node] = forest.value[blank, (node - 1) // 2] if node else 0.5
    return forest


def _level(rows: DataFrame, forest: Forest, weight: np.ndarray, level: int, depth: int, least_leaf: int, n_bins: int, seed: int) -> list:
    """Rows of each class and the best split of every node of a level: (slot, n0, n1, feature, bin)."""
    n, n_nodes, n_trees = len(forest.features), forest.feature.shape[1], len(forest.feature)
    first, width = 2**level - 1, 2**level
    known = rows.sparkSession.sparkContext.broadcast((forest, weight))  # the model
    # nodes of the last level are leaves, of which only the classes count
    bare = level == depth
    each = 2 if bare else n * n_bins * 2

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _ = known.value
        group = np.array(forest.group, dtype=object)
        number = {g: i for i, g in enumerate(dict.fromkeys(forest.group))}
        code = np.array([number[g] for g in group])
        # trees at a time, so that a task's sums stay small whatever the number of trees
        held = list(batches)
        step = max(1, (1 << 22) // (width * each))
        for t0 in range(0, n_trees, step):
            trees = slice(t0, min(n_trees, t0 + step))
            n_own = trees.stop - t0
            total = np.zeros(n_own * width * each, dtype=np.int64)
            # a node's rows are counted by the features that it may split on
            allowed = None if bare else chosen_features(((t0 + np.arange(n_own))[:, None] * n_nodes + first + np.arange(width)).ravel(), n, seed)
            for batch in held:
                x = np.stack([batch.column(f"x{j}").to_numpy() for j in range(n)], axis=1)
                k, y = batch.column("k").to_numpy(), batch.column("y").to_numpy()
                own = np.array([number.get(g, -2) for g in batch.column("g").to_pylist()])
                for a in range(0, len(k), max(1, AT_ONCE // n_own)):
                    b = slice(a, a + max(1, AT_ONCE // n_own))
                    bins = forest.bins(x[b])
                    m = draws(k[b], n_own, t0)
                    if None not in number:
                        m = m * (own[b][:, None] != code[trees][None, :])  # a tree does not see its own group
                    r, t = np.nonzero(m)
                    r, t, m, node = forest.members(bins, trees, r, t, m[r, t], level)
                    slot = t * width + node - first
                    base = slot * each + y[b][r]
                    if bare:
                        np.add.at(total, base, m)
                        continue
                    for j in range(n):
                        some = np.flatnonzero(allowed[slot, j])
                        np.add.at(total, base[some] + (j * n_bins + bins[r[some], j]) * 2, m[some])
            at = np.flatnonzero(total)
            slot, inner = at // each, at % each
            slot = (t0 + slot // width) * n_nodes + first + slot % width
            for a in range(0, len(at), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(slot[b], pa.int64()), pa.array(inner[b], pa.int32()), pa.array(total[at[b]], pa.int64())], ["slot", "at", "n"])

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, weight = known.value
        parts = [tuple(b.column(c).to_numpy() for c in ("slot", "at", "n")) for b in batches if b.num_rows]
        if not parts:
            return
        slot, at, count = (np.concatenate(x) for x in zip(*parts))
        slots, row = np.unique(slot, return_inverse=True)
        step = max(1, (1 << 22) // each)
        for a in range(0, len(slots), step):
            own, here = slots[a : a + step], (row >= a) & (row < a + step)
            sums = np.zeros((len(own), each), dtype=np.int64)
            sums[row[here] - a, at[here]] = count[here]
            if bare:
                columns = [own, sums[:, 0], sums[:, 1], np.full(len(own), -1), np.zeros(len(own))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["slot", "n0", "n1", "feature", "bin"])
                continue
            sums = sums.reshape(len(own), n, n_bins, 2)
            classes = sums.sum(axis=2).max(axis=1)  # the same by each feature that was counted
            w = weight[own // n_nodes]
            if level == 0:
                w = classes.sum(axis=1, keepdims=True) / (2 * np.maximum(classes, 1))
            feature, cut = best_splits(own, sums, w, least_leaf, chosen_features(own, n, seed))
            feature = np.where((classes > 0).all(axis=1), feature, -1)
            columns = [own, classes[:, 0], classes[:, 1], feature, cut]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["slot", "n0", "n1", "feature", "bin"])

    sums = rows.mapInArrow(add_up, "slot long, at int, n long").groupBy("slot", "at").agg(F.sum("n").alias("n"))
    return sums.repartition("slot").mapInArrow(choose, "slot long, n0 long, n1 long, feature long, bin long").collect()


def score(df: DataFrame, forest: Forest, group: str | None = None, name: str = "score") -> DataFrame:
    """``df`` with the forest's share of the label 1; with ``group`` by the trees that have not seen the row's group."""
    model = df.sparkSession.sparkContext.broadcast(forest)
    inputs = [F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(forest.features)]
    rows = df.select(*df.columns, *inputs, (F.col(group) if group else F.lit(None)).cast("string").alias("_g"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} double"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        step = max(1, AT_ONCE // max(1, len(known.feature)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = np.stack([batch.column(f"_x{j}").to_numpy() for j in range(len(known.features))], axis=1)
                found = known.scores(x, batch.column("_g").to_pylist())
                kept = [batch.column(c) for c in df_columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.float64())], [*df_columns, name])

    df_columns = df.columns
    return rows.mapInArrow(work, schema)
