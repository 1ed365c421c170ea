"""Row numbers, resampled rankings and ordered removal against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import graph, learn, ranking, setrates, spatial


def test_numbers_are_those_of_the_order(spark):
    rows = [(i * 7919 % 101, i) for i in range(300)]
    got, n = ranking.numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), [F.desc("a"), F.col("b")])
    assert n == 300
    want = {b: k for k, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {r.b: r.row for r in got.collect()} == want
    none, n = ranking.numbered(spark.createDataFrame([], "a long"), [F.col("a")])
    assert n == 0 and none.count() == 0


def by_hand(rows, replicates):
    """Average precision of each replicate, threshold by threshold."""
    m = ranking.draws(np.array([k for k, _, _ in rows]), replicates)
    y, s = np.array([y for _, y, _ in rows]), np.array([s for _, _, s in rows])
    out = []
    for r in range(replicates):
        p, n = m[y == 1, r].sum(), m[y == 0, r].sum()
        total = 0.0
        for t in sorted(set(s.tolist()), reverse=True):
            at, above = (s == t) & (y == 1), s >= t
            tp, fp = m[above & (y == 1), r].sum() * sum(y) / p, (m[above & (y == 0), r].sum() * sum(1 - y) / n if n else 0)
            total += m[at, r].sum() * sum(y) / p * tp / (tp + fp) if tp + fp else 0
        out.append(total / sum(y))
    return out


@pytest.mark.parametrize("stretches", [1, 3, 40])
def test_replicates_of_a_ranking(spark, monkeypatch, stretches):
    monkeypatch.setattr(ranking, "MOST_STRETCHES", stretches)
    monkeypatch.setattr(ranking, "AT_ONCE", 7)
    r = random.Random(3)
    rows = [(i, int(r.random() < 0.4), float(r.choice([1, 2, 2, 2, 2, 5, r.randrange(30)]))) for i in range(150)]  # one score holds many
    df = spark.createDataFrame(rows, "k long, y int, s double").repartition(4)
    got = ranking.replicate_precisions(df, "k", "y", "s", 20)
    assert np.allclose(got, by_hand(rows, 20))


def test_replicates_without_positives_or_rows(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "k long, y int, s double")
    assert np.isnan(ranking.replicate_precisions(df, "k", "y", "s", 5)).all()
    assert ranking.precision_difference(df.limit(0), "k", "y", "s", "s", 5).first().low is None
    same = ranking.precision_difference(spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "k long, y int, s double"), "k", "y", "s", "s", 30).first()
    assert (same.low, same.middle, same.high, same.share_above) == (0.0, 0.0, 0.0, 0.0)


def test_draws_are_poisson_and_apart():
    m = ranking.draws(np.arange(5000), 200)
    assert abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.03
    assert abs(np.corrcoef(m.T[:40].astype(float)) - np.eye(40)).max() < 0.1
    big = ranking.draws(np.array([2**63 - 1, 2**62]), 5)
    assert big.shape == (2, 5)


def test_dealt_numbers_are_permutations(spark):
    for n in (1, 2, 7, 300):
        rows = spark.range(n).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(11))))
        got = rows.withColumn("j", learn.dealt_number(F.col("id"), F.col("r"), n)).groupBy("r").agg(F.sort_array(F.collect_list("j")).alias("j")).collect()
        assert all(x.j == list(range(n)) for x in got)


def test_removal_is_that_of_the_walk(spark):
    r = random.Random(9)
    pairs = {(g, *sorted(r.sample(range(40), 2))) for g in range(5) for _ in range(25 * g)}
    want = []
    for g in range(5):
        gone = set()
        for i in range(40):
            if i not in gone:
                gone |= {j for h, a, j in pairs if h == g and a == i}
        want += [(g, i) for i in sorted(gone)]
    df = spark.createDataFrame(sorted(pairs), "g long, i long, j long").repartition(4)
    assert sorted((x.g, x.id) for x in graph.greedy_removal(df, ["g"]).collect()) == want
    assert graph.greedy_removal(df.limit(0), ["g"]).count() == 0


def test_points_that_are_not_finite_have_no_partner(spark):
    far = [float("inf"), float("-inf"), float("nan"), None, 1e300]
    a = spark.createDataFrame([(0, 0.0, 0.0), *((i + 1, x, 0.0) for i, x in enumerate(far))], "i long, ax double, ay double")
    b = a.selectExpr("i AS j", "ax AS bx", "ay AS by")
    assert sorted((r.i, r.j) for r in spatial.within(a, b, 5.0).collect()) == [(0, 0), (5, 5)]
    near = spatial.nearest(a.filter("i < 5"), b.filter("j < 5"), "i", "j", 5.0)
    assert [(r.i, r.j) for r in near.collect()] == [(0, 0)]


def test_resampling_of_large_ids(spark):
    df = spark.createDataFrame([(2**63 - 1 - i, i % 2) for i in range(40)], "k long, y int")
    assert 0 < learn.bootstrap_rate(df, "k", "y", 20).first().middle < 1


def test_tails_of_large_tables_take_few_rows(spark):
    cells = spark.createDataFrame([(500_200, 499_800, 499_800, 500_200), (41, 1, 2312, 610), (0, 0, 0, 0), (3, 0, 0, 3)], "a long, b long, c long, d long")
    got = {r.a: (r.p_upper, r.p_lower, r.verdict) for r in setrates.fisher(cells).collect()}
    assert got[3][:2] == (0.05, 1.0) and got[0] == (1.0, 1.0, "no difference")
    # by the normal approximation with a correction for steps: z = 199.5 / sqrt(125000)
    assert abs(got[500_200][0] - 0.2863) < 1e-3
