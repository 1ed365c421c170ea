"""Rates of set membership, with exact intervals and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.names import with_one_deleted, within_one_edit
from wayfold.functions.numbers import count_of, fixed

#: Fixed value: the two-sided 95 % point of the normal distribution.
Z = 1.959964


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of k in n; null for n = 0."""
    n = F.when(n > 0, n)
    z = F.lit(z)
    p = k.cast("double") / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n.cast("double") * n)) / d
    return centre - half, centre + half


def complement(low: Column, high: Column) -> tuple[Column, Column]:
    """The interval of the complementary rate."""
    return 1 - high, 1 - low


def inclusion(population: DataFrame, reference: DataFrame, district: list[str], name: str, pooled: str) -> DataFrame:
    """Per district and pooled: how many names of the population the reference has, with its interval.

    Both sides are distinct (district, name) rows.
    """
    held = population.join(reference.withColumn("_in", F.lit(1)), [*district, name], "left")
    key = district[0]
    counted = (
        held.groupingSets([district, []], *district)
        .agg(F.grouping(key).alias("_all"), F.count(F.lit(1)).alias("n"), F.count("_in").alias("k"))
        .withColumn(key, F.when(F.col("_all") == 1, pooled).otherwise(F.col(key)))
    )
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select(*district, "n", "k", fixed(F.col("k").cast("double") / F.col("n")).alias("rate"), fixed(low).alias("low"), fixed(high).alias("high"))


def treatment_and_control(population: DataFrame, reference: DataFrame, district: str, name: str, treated: str) -> DataFrame:
    """Missing names of either arm, and how many of them another district has."""
    own = reference.select(district, name).distinct().withColumn("_own", F.lit(True))
    anywhere = reference.select(name).distinct().withColumn("_any", F.lit(True))
    held = population.join(own, [district, name], "left").join(anywhere, name, "left")
    missing = F.col("_own").isNull()
    return held.groupBy(treated).agg(
        F.count(F.lit(1)).alias("n"),
        count_of(missing).alias("n_missing"),
        count_of(missing & F.col("_any").isNotNull()).alias("n_found_elsewhere"),
    )


def near_name(missing: DataFrame, name: str, reference: DataFrame, other: str, keys: list[str] | None = None) -> DataFrame:
    """Whether a name has one within one edit in the reference (of the same ``keys``).

    Names within one edit share a text with one character left out, so the
    join is by equality; the edit distance confirms.
    """
    keys = keys or []
    a = missing.select(*keys, name, F.explode(with_one_deleted(F.col(name))).alias("_cut"))
    b = reference.select(*keys, other, F.explode(with_one_deleted(F.col(other))).alias("_cut"))
    hits = a.join(b, [*keys, "_cut"]).filter(within_one_edit(F.col(name), F.col(other))).select(*keys, name).distinct()
    return missing.join(hits.withColumn("near", F.lit(True)), [*keys, name], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def log_factorial(n: Column) -> Column:
    """ln n!: a sum for small n, Stirling's series beyond."""
    x = n.cast("double") + 1
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n.cast("int"), F.lit(40)))), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double"))
    )
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 40, small).otherwise(series)


#: Standard deviations (and, for small margins, their square as a number of cells) beyond which tables are left out.
REACH = 14


def fisher(cells: DataFrame) -> DataFrame:
    """Both one-sided tails of tables (a, b; c, d), and the verdict at 0.05, the upper tail first.

    The sum runs over the tables with these margins whose cell lies within
    ``REACH`` standard deviations of its mean, one row each; all others together
    have a probability far below any digit kept.  So there are as many rows as
    the root of the margins.
    """
    row, column, total = F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    low, high = F.greatest(F.lit(0).cast("long"), row + column - total), F.least(row, column)
    n, share = total.cast("double"), F.when(total > 0, row / total).otherwise(0.0)
    mean = share * column
    spread = F.sqrt(F.when(total > 1, mean * (1 - share) * (n - column) / (n - 1)).otherwise(0.0))
    near = REACH * spread + REACH * REACH
    first, last = F.floor(mean - near).cast("long"), F.ceil(mean + near).cast("long")
    terms = cells.withColumn("i", F.explode(F.sequence(F.greatest(low, first), F.least(high, last))))
    i = F.col("i")
    log_p = (
        log_factorial(row)
        + log_factorial(F.col("c") + F.col("d"))
        + log_factorial(column)
        + log_factorial(F.col("b") + F.col("d"))
        - log_factorial(total)
        - log_factorial(i)
        - log_factorial(row - i)
        - log_factorial(column - i)
        - log_factorial(F.col("d") - F.col("a") + i)
    )
    p = F.exp(log_p)
    tails = terms.groupBy("a", "b", "c", "d").agg(
        F.least(F.lit(1.0), F.sum(F.when(i >= F.col("a"), p).otherwise(0.0))).alias("up"),
        F.least(F.lit(1.0), F.sum(F.when(i <= F.col("a"), p).otherwise(0.0))).alias("down"),
    )
    verdict = F.when(F.col("up") < 0.05, "higher").when(F.col("down") < 0.05, "lower").otherwise("no difference")
    return tails.select("a", "b", "c", "d", fixed(F.col("up"), 6).alias("p_upper"), fixed(F.col("down"), 6).alias("p_lower"), verdict.alias("verdict"))
