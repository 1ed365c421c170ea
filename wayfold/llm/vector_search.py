"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt to shards by a hash of their id, and each shard becomes a
KD-tree with median splits and tight bounding boxes.  A box bounds the inner
product of a query with all its vectors, so a query walks a tree best bound
first and stops when no box can beat its k-th result.

The k-th results travel: every query first walks one shard; then blocks of
queries walk groups of shards, each group's first tree starting from the k-th
score of the first pass and each next tree from the best so far.  Results of
the groups are merged by rank.  Queries are a stated set and meet the trees in
blocks; no rows are made for pairs that are not results of a tree.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.workers import tidy
from wayfold.workspace import Workspace

SCALE = 256
#: Vectors of a shard and of a leaf, queries of a block, shards that a block walks in a row.
SHARD, LEAF, BLOCK, GROUP = 8192, 64, 1024, 8


def saturated(scores: np.ndarray) -> np.ndarray:
    """Python's integers within 64 bits; floats are smaller anyway."""
    return np.clip(scores, -(2**63), 2**63 - 1) if scores.dtype == object else scores


class KDTree:
    """Boxes in depth-first order; a node is a leaf if it has no children."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high, self.least, self.children, self.span = [], [], [], [], []
        where = np.arange(len(ids))
        self.order = np.empty(len(ids), dtype=np.int64)
        self.filled = 0
        self._build(where)
        self.ids, self.vectors = self.ids[self.order], self.vectors[self.order]
        del self.order, self.filled
        self.low, self.high = np.stack(self.low), np.stack(self.high)
        for kind in (np.int16, np.int32):  # trees travel to every block of queries
            if self.vectors.min() >= np.iinfo(kind).min and self.vectors.max() <= np.iinfo(kind).max:
                self.vectors, self.low, self.high = (x.astype(kind) for x in (self.vectors, self.low, self.high))
                break
        # float64 holds these products and sums exactly, or else Python's integers are used
        top = float(np.abs(self.vectors.astype(np.float64)).max(initial=0))
        self.exact = top < 2**23 and vectors.shape[1] * top * top < 2**52

    def _build(self, where: np.ndarray) -> int:
        """Nodes are made from a stack, so that depth is no limit."""
        stack = [(where, -1, 0)]
        root = 0
        while stack:
            rows, parent, side = stack.pop()
            v = self.vectors[rows]
            node = len(self.low)
            low, high = v.min(axis=0), v.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(self.ids[rows].min()))
            self.children.append([-1, -1])
            self.span.append((0, 0))
            if parent >= 0:
                self.children[parent][side] = node
            wide = high.astype(np.float64) - low
            if len(rows) <= LEAF or not wide.any():
                self.span[node] = (self.filled, self.filled + len(rows))
                self.order[self.filled : self.filled + len(rows)] = np.sort(rows)
                self.filled += len(rows)
                continue
            axis = int(np.argmax(wide))
            x = v[:, axis]
            # the median, or the next value above it that leaves both sides filled
            left = x < np.partition(x, len(x) // 2)[len(x) // 2]
            if not left.any():
                left = x <= x.min()
            stack += [(rows[~left], node, 1), (rows[left], node, 0)]
        return root

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
        """Update ``best``, for each query its k (score, -id), as a heap; ``own`` ids are left out."""
        exact = self.exact and float(np.abs(queries.astype(np.float64)).max(initial=0)) < 2**23
        kind = np.float64 if exact else object
        q = queries.astype(np.int64).astype(kind)
        high, low, vectors = (x.astype(np.int64).astype(kind) for x in (self.high, self.low, self.vectors))
        bound = saturated(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
        for i in range(len(q)):
            heap, mine, reach = best[i], int(own[i]), bound[i].tolist()
            todo = [(-reach[0], self.least[0], 0)]
            while todo:
                value, least, node = heapq.heappop(todo)
                if len(heap) == k and (-value, -least) <= heap[0]:
                    break
                left, right = self.children[node]
                if left >= 0:
                    heapq.heappush(todo, (-reach[left], self.least[left], left))
                    heapq.heappush(todo, (-reach[right], self.least[right], right))
                    continue
                a, b = self.span[node]
                scores = saturated(vectors[a:b] @ q[i])
                ids = self.ids[a:b]
                if len(heap) == k:
                    close = scores >= heap[0][0]
                    scores, ids = scores[close], ids[close]
                if len(ids) > k + 1:
                    top = np.lexsort((ids, -scores))[: k + 1]
                    scores, ids = scores[top], ids[top]
                for s, j in zip(scores.tolist(), ids.tolist()):
                    if j != mine:
                        (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (int(s), -j))


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component.

    Left out are vectors that are null or empty or have no vec_id, and those
    with a component that is null or not finite, or that doesn't fit 64 bits.
    """
    scaled = lambda x: x.cast("double") * F.lit(scale)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(scaled(x)) >= F.lit(2.0**63)))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select(
        "vec_id",
        F.size("embedding").alias("dim"),
        F.transform("embedding", lambda x: F.floor(scaled(x)).cast("long")).alias("v"),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def build_trees(vectors: DataFrame, n_shards: int) -> DataFrame:
    """(dim, shard, tree): one pickled tree for each shard of vectors of one dimension."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        tree = KDTree(table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks(), dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "tree": [pickle.dumps(tree)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def walk(rows: DataFrame, k: int) -> DataFrame:
    """Results of blocks of queries in groups of trees.

    ``rows`` are (block, grp, shard, tree, queries): for each block and group
    one row with queries, shard -1, and one for each tree of the group.
    """

    @tidy
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> pa.RecordBatch:
            ids, _, best = state
            found = [(int(q), -j, s) for q, heap in zip(ids, best) for s, j in heap]
            q, v, s = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, v, s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in ("dim", "block", "grp"))
                if key != now:
                    if state:
                        yield done()
                    now, state = key, None
                if batch.column("shard")[i].as_py() < 0:
                    queries = batch.column("queries")[i].as_py()
                    ids = np.array([x["vec_id"] for x in queries], dtype=np.int64)
                    floor = [x["floor"] for x in queries]
                    best = [[(s, -j) for s, j in zip(f["scores"], f["ids"])] if f else [] for f in floor]
                    for heap in best:
                        heapq.heapify(heap)
                    state = ids, np.array([x["v"] for x in queries], dtype=np.int64), best
                elif state:
                    pickle.loads(batch.column("tree")[i].as_py()).search(state[1], state[0], k, state[2])
        if state:
            yield done()

    ordered = rows.repartition("dim", "block", "grp").sortWithinPartitions("dim", "block", "grp", "shard")
    return ordered.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest inner products of each query with all other vectors.

    ``vectors`` and ``queries`` are quantised tables (vec_id, dim, v).  Columns:
    query_id, rank, vec_id, score; ties go to the smaller vec_id.

    * A query is compared with vectors of its dimension only.  A query
      without any has no rows.
    * Rows that repeat a vec_id are one vector, the least of them by value.
    * A score beyond 64 bits is the nearest 64-bit integer.
    """
    work = Workspace(vectors.sparkSession, "top-k")
    one = work.table(vectors.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v"), "vectors")
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    n, n_asked = one.count(), asked.count()
    n_shards, n_blocks = max(1, -(-n // SHARD)), max(1, -(-n_asked // BLOCK))
    trees = work.table(build_trees(one, n_shards).withColumn("grp", F.floor(F.col("shard") / GROUP).cast("int")), "trees")
    asked = work.table(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")), "queries", small=True)

    def rows(blocks: DataFrame, meets: DataFrame) -> DataFrame:
        """``meets`` is (dim, block, grp, shard) of the trees that each block walks."""
        q = meets.select("dim", "block", "grp").distinct().join(blocks, ["dim", "block"])
        q = q.select("dim", "block", "grp", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("tree"), "queries")
        t = meets.join(trees.drop("grp"), ["dim", "shard"]).select(
            "dim", "block", "grp", "shard", "tree", F.lit(None).cast(q.schema["queries"].dataType).alias("queries")
        )
        return q.unionByName(t)

    def blocks_of(table: DataFrame) -> DataFrame:
        return table.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("queries"))

    shards = trees.select("dim", "shard", "grp")
    blocks = asked.select("dim", "block").distinct()
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    # first pass: one shard, another one for each block
    nothing = F.lit(None).cast("struct<ids: array<bigint>, scores: array<bigint>>")
    turn = F.row_number().over(Window.partitionBy("dim", "block").orderBy(F.xxhash64("shard", "block"), "shard"))
    home = blocks.join(shards, "dim").withColumn("turn", turn).filter("turn = 1").drop("turn")
    home = work.table(home, "home", small=True)
    first = work.table(walk(rows(blocks_of(asked.withColumn("floor", nothing)), home), k), "first", small=True)
    floors = first.groupBy("query_id").agg(
        F.struct(F.collect_list("vec_id").alias("ids"), F.collect_list("score").alias("scores")).alias("floor")
    )
    # second pass: all other shards, in groups, from the k-th score of the first
    informed = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").drop("query_id")
    rest = blocks.join(shards, "dim").join(home.drop("grp"), ["dim", "block", "shard"], "left_anti")
    second = walk(rows(blocks_of(informed), rest), k)
    found = first.unionByName(second).distinct()
    return (
        found.withColumn("rank", F.row_number().over(rank).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector among all; see :func:`quantised` and :func:`top_k`."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


ORACLE = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e AS q JOIN e AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
