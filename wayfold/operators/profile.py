"""Profiles: conditional counts, margins, bins, percentiles, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.numbers import count_of, fixed, rate


def valued_profile(df: DataFrame, value: str, group: Column, label: str, exact: float, total: str = "ALL") -> DataFrame:
    """Per group and over all rows: rows, missing, zero, exactly ``exact``, and p10, p50 and p90 of the values.

    Both grains come from one aggregation with grouping sets.
    """
    v = F.col(value)
    return (
        df.withColumn("_g", group)
        .groupingSets([["_g"], []], "_g")
        .agg(
            F.grouping("_g").alias("_all"),
            F.count(F.lit(1)).alias("n"),
            count_of(v.isNull()).alias("n_missing"),
            count_of(v == 0).alias("n_zero"),
            count_of(v == exact).alias("n_exact"),
            rate(count_of(v == exact), F.count(F.lit(1))).alias("exact_rate"),
            *(fixed(F.percentile(v, F.lit(p))).alias(f"p{round(100 * p)}") for p in (0.1, 0.5, 0.9)),
        )
        .select(F.when(F.col("_all") == 1, total).otherwise(F.col("_g")).alias(label), "*")
        .drop("_g", "_all")
    )


def conditional_rate(df: DataFrame, keys: list[str], valued: Column, condition: Column, name: str) -> DataFrame:
    """Rate of a condition among valued rows; null if there are none."""
    return df.groupBy(*keys).agg(
        count_of(valued).alias("n_valued"),
        count_of(valued & condition).alias(f"n_{name}"),
        rate(count_of(valued & condition), count_of(valued)).alias(f"{name}_rate"),
    )


def crosstab(df: DataFrame, row: str, column: str, measures: list[Column], row_total: str, column_total: str) -> DataFrame:
    """Measures for each pair, each row, each column and all; pairs without rows are left out."""
    return (
        df.cube(row, column)
        .agg(F.grouping(row).alias("_r"), F.grouping(column).alias("_c"), *measures)
        .withColumn(row, F.when(F.col("_r") == 1, row_total).otherwise(F.col(row)))
        .withColumn(column, F.when(F.col("_c") == 1, column_total).otherwise(F.col(column)))
        .drop("_r", "_c")
    )


def bin_pivot(df: DataFrame, keys: list[str], bins: Column, labels: list[str], names: list[str]) -> DataFrame:
    """A column of counts for each bin."""
    return df.withColumn("_bin", bins).groupBy(*keys).agg(*(count_of(F.col("_bin") == b).alias(n) for b, n in zip(labels, names)))


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of each group with how many rows lie up to each, and the group's rows.

    Rows are counted before any shuffle; the window sorts distinct values only,
    and spills.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    return counted.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))


def _name(p: float) -> str:
    return f"p{100 * p:g}".replace(".", "_")


def percentiles(df: DataFrame, keys: list[str], value: str, points: list[float], hot: bool = False) -> DataFrame:
    """Interpolated percentiles, as fixed numbers.

    With ``hot`` no aggregation buffer holds a group's values.
    """
    if not hot:
        return df.groupBy(*keys).agg(*(fixed(F.percentile(value, F.lit(p))).alias(_name(p)) for p in points))
    v, upto = F.col(value), F.col("upto")
    place = {p: F.lit(p) * (F.col("n") - 1) for p in points}
    ends = []
    for p, h in place.items():
        ends += [F.min(F.when(upto > F.floor(h), v)).alias(f"{_name(p)}_a"), F.min(F.when(upto > F.ceil(h), v)).alias(f"{_name(p)}_b")]
    rows = _counted(df, keys, value).groupBy(*keys).agg(F.max("n").alias("n"), *ends)
    out = []
    for p, h in place.items():
        a, b = F.col(f"{_name(p)}_a"), F.col(f"{_name(p)}_b")
        out.append(fixed(a + (b - a) * (h - F.floor(h))).alias(_name(p)))
    return rows.select(*keys, *out)


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted values."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


def index_p10(values: Column) -> Column:
    """The element at max(0, n // 10 - 1) of the sorted values."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.greatest(F.lit(0), F.floor(F.size(s) * 0.1) - 1) + 1).cast("int")))


def order_statistics(df: DataFrame, keys: list[str], value: str, hot: bool = False) -> DataFrame:
    """Upper median and p10 by index of each group, exactly.

    With ``hot`` no group is gathered: values are counted first, and ranks run
    over the distinct values.
    """
    if not hot:
        v = F.collect_list(value)
        return df.groupBy(*keys).agg(
            F.count(value).alias("n"), F.min(value).alias("least"), index_p10(v).alias("p10"), upper_median(v).alias("upper_median")
        )
    upto = _counted(df, keys, value)
    at_median, at_p10 = F.floor(F.col("n") / 2) + 1, F.greatest(F.lit(0), F.floor(F.col("n") * 0.1) - 1) + 1
    return upto.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.min(value).alias("least"),
        F.min(F.when(F.col("upto") >= at_p10, F.col(value))).alias("p10"),
        F.min(F.when(F.col("upto") >= at_median, F.col(value))).alias("upper_median"),
    )


def modes(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties to the smaller value."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counted.withColumn("place", place.cast("int")).filter(F.col("place") <= k)


def edge_histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts between edges, the last edge included, empty bins too; null and NaN are in none."""
    spark = df.sparkSession
    last = len(edges) - 2
    bins = [(i, edges[i], edges[i + 1]) for i in range(last + 1)]
    which = F.lit(None).cast("int")
    for i, low, high in reversed(bins):
        inside = (value >= low) & ((value <= high) if i == last else (value < high)) & ~F.isnan(value)
        which = F.when(inside, i).otherwise(which)
    counted = df.select(which.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame(bins, "bin int, low double, high double")
    return table.join(counted, "bin", "left").select(
        "bin", "low", "high", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def shares(df: DataFrame, source: str, label: str, weight: Column | None = None) -> DataFrame:
    """Share of each label within its source, by rows or by whole weights; rows without a label are left out."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.filter(F.col(label).isNotNull()).groupBy(source, label).agg(size.alias("part"))
    whole = F.sum("part").over(Window.partitionBy(source))
    return counted.withColumn("share", rate(F.col("part"), whole, 6))


def named_and_missing(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Disjoint counts: missing, not a number, zero, other numbers."""
    t = F.trim(F.col(text))
    blank = F.col(text).isNull() | (t == "")
    x = t.try_cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_of(blank).alias("n_missing"),
        count_of(~blank & x.isNull()).alias("n_text"),
        count_of(x == 0).alias("n_zero"),
        count_of(x != 0).alias("n_number"),
    )


def funnel(df: DataFrame, key: str, stages: dict[str, Column], total: str) -> DataFrame:
    """Rows of each key that pass each stage alone and all of them, with a total row."""
    both = F.lit(True)
    for c in stages.values():
        both = both & c
    counts = [count_of(c).alias(name) for name, c in stages.items()]
    first = next(iter(stages))
    return (
        df.rollup(key)
        .agg(F.grouping(key).alias("_all"), F.count(F.lit(1)).alias("n_raw"), *counts, count_of(both).alias("n_all"))
        .withColumn(key, F.when(F.col("_all") == 1, total).otherwise(F.col(key).cast("string")))
        .withColumn("excluded", rate(F.col(first) - F.col("n_all"), F.col(first)))
        .drop("_all")
    )


def worst_of(df: DataFrame, keys: list[str], rank: Column, names: dict[int, str], unknown: str) -> DataFrame:
    """The lowest known rank of each group by name; unknown if none is known."""
    low = F.min(F.when(rank > 0, rank))
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), low.alias("worst")).select(
        *keys, "n", F.coalesce(name[F.col("worst")], F.lit(unknown)).alias("worst")
    )
