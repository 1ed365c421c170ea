"""Many rows at few places: places are measured once, and nothing that grows is collected for a broadcast."""

import time

import pytest
from pyspark.sql import functions as F

from wayfold.operators import polyline, spatial


def placed(spark, n, name, x, y):
    """``n`` rows at eight places, ten apart."""
    i = F.col("id")
    return spark.range(n).select(i.alias(name), (i % 4 * 10).cast("double").alias(x), (F.floor(i / 4) % 2 * 10).cast("double").alias(y))


def test_nearest_of_copies(spark):
    left, right = placed(spark, 40_000, "i", "ax", "ay"), placed(spark, 40_000, "j", "bx", "by")
    start = time.time()
    got = spatial.nearest(left, right, "i", "j", 100.0, k=3).cache()
    assert got.count() == 120_000
    # the three smallest of each place are its first row and those 8 and 16 further on
    assert got.filter("d <> 0 OR j <> i % 8 + 8 * (place - 1)").count() == 0
    assert time.time() - start < 40  # all pairs are 1.6e9


def test_flags_and_pairs_of_copies(spark):
    left, right = placed(spark, 40_000, "i", "ax", "ay"), placed(spark, 40_000, "j", "bx", "by")
    start = time.time()
    flagged = spatial.near_flag(left, right.filter("bx = 0"), "i", 10.0, "near")
    assert flagged.filter("near").count() == 20_000
    assert time.time() - start < 20
    few = spatial.within(placed(spark, 16, "i", "ax", "ay"), placed(spark, 24, "j", "bx", "by"), 10.0)
    assert few.count() == 2 * 3 * (8 + 2 * 4 + 2 * 6) and few.filter("d > 10").count() == 0


def test_dense_places_go_by_cells(spark, monkeypatch):
    """A reach whose cells hold too many points is not searched pair by pair."""
    monkeypatch.setattr(spatial, "LEAF", 8)
    monkeypatch.setattr(spatial, "doubling", None)
    n = 400
    left = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 20).cast("double").alias("ax"), F.floor(F.col("id") / 20).cast("double").alias("ay"))
    right = left.select(F.col("i").alias("j"), (F.col("ax") + 0.25).alias("bx"), F.col("ay").alias("by"))
    got = spatial.nearest(left, right, "i", "j", 100.0)
    assert got.count() == n and got.filter("i <> j OR d <> 0.25").count() == 0


def ends(spark, n):
    i = F.col("id") % 10

    def p(x, y):
        return F.struct(x.cast("double").alias("x"), F.lit(y).cast("double").alias("y"))

    return spark.range(n).select(F.col("id").alias("l"), F.array(p(i * 10, 0.0), p(i * 10, 1.0)).alias("line"))


def test_end_degree_of_copies(spark):
    start = time.time()
    got = polyline.end_degree(ends(spark, 40_000), "l", "line", 2.0)
    assert got.filter("degree <> 3999").count() == 0 and got.count() == 40_000
    assert time.time() - start < 20  # all pairs of ends are 6.4e8


def test_end_degree_without_a_place(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, None)]), (2, [(0.0, 0.5)]), (3, []), (4, None), (5, [(None, 1.0)])], "l long, line array<struct<x: double, y: double>>")
    assert {r.l: r.degree for r in polyline.end_degree(df, "l", "line", 2.0).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


@pytest.mark.parametrize("name", ["end_degree", "dwithin_pairs", "spatial_flag_join"])
def test_no_broadcast_of_what_grows(spark, name):
    """The tables' files are small, what is made of them is not."""
    from wayfold.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def lists_of(spark, tmp_path, name):
    """The query over customers and suppliers that stand at few places, against its SQL."""
    import duckdb

    from wayfold.plans import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"COPY (SELECT i * 250 AS c_custkey, CAST(i // 4 % 3 AS INTEGER) AS c_nationkey FROM range(3000) r(i)) TO '{tmp_path}/customer.parquet'")
    con.sql(f"COPY (SELECT i * 250 AS s_suppkey, CAST(i % 3 AS DOUBLE) - 1 AS s_acctbal FROM range(3000) r(i)) TO '{tmp_path}/supplier.parquet'")
    for t in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    return sorted(map(tuple, got.collect())), sorted(want.fetchall()), got


def test_lists_of_copies(spark, tmp_path):
    got, want, df = lists_of(spark, tmp_path, "same_name_near")
    assert got == want
    # each list is gathered once a place, not once a row
    assert "array_remove" in df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_copies(spark, tmp_path):
    got, want, df = lists_of(spark, tmp_path, "facility_counts")
    assert got == want
    assert "collect_set(s_suppkey" not in df._jdf.queryExecution().optimizedPlan().toString()  # no group holds all keys


@pytest.mark.parametrize("name", ["medial_widths", "resample_medial", "clipped_stretches", "covered_share"])
def test_small_files_of_costly_rows_are_dealt(spark, name):
    """A file of a few megabytes is one task, whatever is done to its rows."""
    from wayfold.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    # no sample is written out in a pushed filter
    assert name != "resample_medial" or not any("aggregate(" in line and "chainage" in line and "Filter" in line for line in plan.splitlines())


def test_keys_of_both_sides_meet_once(spark):
    """No join of either side's distinct keys, and partitions that are not merged."""
    from wayfold.plans import QUERIES

    plan = QUERIES["symmetric_keys"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
