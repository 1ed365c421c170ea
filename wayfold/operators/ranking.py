"""Row numbers over whole tables, and what is computed along a ranking.

A window without a partition would put all rows into one task.  Rows are dealt
to ranges instead: a row's number is the number of rows in the ranges before its
own and its place within it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.numbers import fixed
from wayfold.workspace import Workspace

#: Stretches of a ranking that are worked on side by side; their sums are all that meets in one place.
MOST_STRETCHES = 512
#: Rows whose multiplicities are held at a time.
AT_ONCE = 512
_P = 2147483647


def numbered(df: DataFrame, order: list[Column], name: str = "row") -> tuple[DataFrame, int]:
    """``df`` with numbers from 0 in the given order, and how many rows there are.

    Rows that are equal in ``order`` are numbered in any order, but once and for all:
    the result is a written table.
    """
    spark = df.sparkSession
    work = Workspace(spark, "numbered")
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    # the number of the range stands above 33 bits of the place in it
    ranged = work.table(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    before, n = {}, 0
    for r in sorted(sizes, key=lambda r: r.r):
        before[r.r] = n
        n += r.n
    starts = spark.createDataFrame(sorted(before.items()), "_r long, _b long")
    placed = ranged.withColumn("_r", F.shiftright("_at", 33)).join(F.broadcast(starts), "_r")
    return placed.withColumn(name, F.col("_b") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name), n


# ---------------------------------------------------------------- bootstrap of a difference
#: Upper ends, in millionths, of the multiplicities 0 to 6 of a Poisson variable of mean 1; beyond is 7.
POISSON = (367879, 735759, 919699, 981012, 996340, 999406, 999917)


def draws(keys: np.ndarray, replicates: int, first: int = 0) -> np.ndarray:
    """How often each row (by its whole-number key) is in each replicate, from the ``first`` one on.

    Three steps of a congruence modulo a prime with shifts between them; all products stay under 64 bits.
    """
    k = (keys.astype(np.int64) % _P)[:, None]
    r = np.arange(first + 1, first + replicates + 1, dtype=np.int64)[None, :]
    x = (k * 48271 + r * 69621) % _P
    x = ((x ^ (x >> 15)) * 1103515245 + r) % _P
    x = ((x ^ (x >> 13)) * 69621 + k) % _P
    return _multiplicities()[(x ^ (x >> 16)) % 1_000_000].astype(np.int64)


@lru_cache(maxsize=1)
def _multiplicities() -> np.ndarray:
    """The multiplicity of each of a million numbers: a look-up costs less than a search."""
    return np.searchsorted(np.array(POISSON), np.arange(1_000_000), side="right").astype(np.uint8)


def draws_sql(key: str, replicate: str) -> str:
    """The same number in SQL; ``replicate`` counts from 0."""
    k, r = f"({key} % {_P})", f"({replicate} + 1)"
    x = f"(({k} * 48271 + {r} * 69621) % {_P})"
    x = f"((xor({x}, {x} >> 15) * 1103515245 + {r}) % {_P})"
    x = f"((xor({x}, {x} >> 13) * 69621 + {k}) % {_P})"
    u = f"(xor({x}, {x} >> 16) % 1000000)"
    return f"({' + '.join(f'CAST({u} >= {p} AS BIGINT)' for p in POISSON)})"


def replicate_precisions(df: DataFrame, key: str, label: str, score: str, replicates: int) -> np.ndarray:
    """Average precision (step; equal scores are one threshold) of a ranking in each replicate.

    Both classes are drawn from by themselves and weighted back to their sizes, so
    that a replicate has the classes' shares.  One pass sums each stretch of the
    ranking, another one walks it; a threshold that spans stretches is put together
    from its parts.  NaN for a replicate without a positive row.
    """
    rows, n = numbered(df.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s")), [F.desc("s"), F.col("k")])
    if not n:
        return np.full(replicates, np.nan)
    stretch = F.floor(F.col("row") / F.lit(-(-n // MOST_STRETCHES))).cast("int")
    dealt = rows.withColumn("part", stretch).repartition("part").sortWithinPartitions("part", "row").select("part", "k", "y", "s")

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            part, k, y, s = (batch.column(c).to_numpy() for c in ("part", "k", "y", "s"))
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                for at in range(a, b, AT_ONCE):
                    to = min(b, at + AT_ONCE)
                    yield int(part[at]), k[at:to], y[at:to], s[at:to]

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part, k, y, _ in parts(batches):
            m = draws(k, replicates)
            sums.setdefault(part, np.zeros((2, replicates), np.int64))
            sums[part] += np.stack([m[y == 1].sum(axis=0), m[y != 1].sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.reshape(-1).tolist() for x in sums.values()], pa.list_(pa.int64()))], ["part", "sums"])

    # one row of numbers a stretch
    found = {r.part: np.array(r.sums).reshape(2, replicates) for r in dealt.mapInArrow(total, "part int, sums array<long>").collect()}
    before, running = {}, np.zeros((2, replicates), np.int64)
    for part in sorted(found):
        before[part] = running.copy()
        running += found[part]
    one = rows.agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p")).first()
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.stack([one.p / running[0], (n - one.p) / np.maximum(running[1], 1)])
    known = df.sparkSession.sparkContext.broadcast((before, weight))  # at most MOST_STRETCHES stretches

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, weight = known.value
        out: list[tuple[float | None, np.ndarray, np.ndarray]] = []
        now, state, gained, inner, last, first = None, None, None, None, None, True

        def close() -> Iterator[tuple]:
            yield None, inner, state
            yield last, gained, state

        for part, k, y, s in parts(batches):
            if part != now:
                if now is not None:
                    out += close()
                now, state, inner, last, first = part, before[part].copy(), np.zeros(replicates), None, True
                gained = np.zeros(replicates)
            m = draws(k, replicates)
            up, down = np.cumsum(m * (y == 1)[:, None], axis=0), np.cumsum(m * (y != 1)[:, None], axis=0)
            ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
            if last is not None and last != s[0]:  # the threshold before is complete
                if first:
                    out.append((last, gained, state.copy()))
                else:
                    inner += _step(gained, state, weight)
                first, gained = False, np.zeros(replicates)
            base, at = state.copy(), 0
            for e in ends:
                gained = gained + (up[e] - (up[at - 1] if at else 0))
                state = np.stack([base[0] + up[e], base[1] + down[e]])
                last, at = s[e], e + 1
                if e != ends[-1]:
                    if first:
                        out.append((last, gained, state))
                    else:
                        inner += _step(gained, state, weight)
                    first, gained = False, np.zeros(replicates)
        if now is not None:
            out += close()
        scores, gains, states = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(scores, pa.float64()), pa.array([g.tolist() for g in gains], pa.list_(pa.float64())), pa.array([x.reshape(-1).tolist() for x in states], pa.list_(pa.int64()))],
            ["s", "gained", "state"],
        )

    whole, open_ = np.zeros(replicates), {}
    for r in dealt.mapInArrow(walk, "s double, gained array<double>, state array<long>").collect():  # three rows a stretch
        gained, state = np.array(r.gained), np.array(r.state).reshape(2, replicates)
        if r.s is None:
            whole += gained
        else:
            g, x = open_.get(r.s, (0, np.zeros_like(state)))
            open_[r.s] = (g + gained, np.maximum(x, state))
    for gained, state in open_.values():
        whole += _step(gained, state, weight)
    return np.where(running[0] > 0, whole / max(one.p, 1), np.nan)


def _step(gained: np.ndarray, state: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What a threshold adds to the average precision times the number of positives."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = state * weight
        return np.nan_to_num(gained * weight[0] * up / (up + down))


def precision_difference(df: DataFrame, key: str, label: str, first: str, second: str, replicates: int = 1000) -> DataFrame:
    """Average precision of two scores and the 95 % interval of their difference over stratified resamples.  One row."""
    a, b = (replicate_precisions(df, key, label, s, replicates) for s in (first, second))
    diff = (a - b)[~np.isnan(a - b)]
    low, middle, high = np.quantile(diff, [0.025, 0.5, 0.975]).tolist() if len(diff) else (None,) * 3
    one = df.sparkSession.createDataFrame([(replicates, low, middle, high, float((diff > 0).mean()) if len(diff) else None)], "replicates long, low double, middle double, high double, share_above double")
    return one.select("replicates", *(fixed(F.col(c)).alias(c) for c in ("low", "middle", "high", "share_above")))
