"""Classifier data and measures, and models by leaving one group out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.numbers import fixed
from wayfold.operators import forest
from wayfold.operators.ranking import numbered


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values as the median of the column, which travels as one row."""
    medians = df.agg(*(F.median(c).alias(f"_m_{c}") for c in columns))
    return df.join(F.broadcast(medians)).select(
        *(F.coalesce(c, f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns)
    )


def one_hot(column: Column, values: list, prefix: str) -> list[Column]:
    return [F.coalesce((column == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def running(df: DataFrame, order: str, sums: list[str], parts: int = 64, keys: list[str] | None = None) -> DataFrame:
    """Sums over all rows (of the same ``keys``) with at least this value, without one task that holds all rows.

    ``order`` is distinct within the keys.  Rows are cut at quantiles; the sums of
    whole parts are one small table, of ``parts`` rows for each key.
    """
    keys = keys or []
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    placed = df.join(F.broadcast(cuts)).withColumn(
        "_part", F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    ).drop("_cuts")
    totals = placed.groupBy(*keys, "_part").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    above = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", *(F.coalesce(F.sum(f"_t_{s}").over(above), F.lit(0)).alias(f"_b_{s}") for s in sums))
    within = Window.partitionBy(*keys, "_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(before if keys else F.broadcast(before), [*keys, "_part"])
    return joined.select(
        *keys, order, *sums, *((F.sum(s).over(within) + F.col(f"_b_{s}")).cast("long").alias(f"cum_{s}") for s in sums)
    )


def ranking_measures(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Average precision (step) and ROC AUC; equal scores count as one threshold.  One row (for each of ``keys``)."""
    keys = keys or []
    per = df.groupBy(*keys, score).agg(F.sum(label).cast("long").alias("pos"), (F.count(F.lit(1)) - F.sum(label)).cast("long").alias("neg"))
    cum = running(per, score, ["pos", "neg"], keys=keys)
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    sums = cum.groupBy(*keys).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("ap"),
        # positives above each negative, ties half
        F.sum(F.col("neg") * (tp - F.col("pos").cast("double") / 2)).alias("area"),
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    return sums.select(
        *keys,
        F.col("p").alias("n_positive"),
        F.col("n").alias("n_negative"),
        fixed(F.col("ap") / F.when(p > 0, p)).alias("average_precision"),
        fixed(F.col("area") / F.when((p > 0) & (n > 0), p * n)).alias("roc_auc"),
    )


def precision_at(df: DataFrame, label: str, score: str, key: str, k: int) -> DataFrame:
    """Precision among the k highest scores, ties to the smaller key."""
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.agg(F.count(F.lit(1)).alias("k"), F.sum(label).cast("long").alias("hits")).withColumn(
        "precision", fixed(F.col("hits").cast("double") / F.when(F.col("k") > 0, F.col("k")))
    )


#: Upper ends, in thousandths, of the multiplicities 0, 1, 2, 3 of a Poisson variable of mean 1; beyond is 4.
POISSON = (368, 736, 920, 981)


def multiplicity(key: Column, replicate: Column) -> Column:
    """How often a row is in a replicate, from a hash of whole numbers; factors are cut first, so that no id overflows."""
    k, r = F.pmod(key, F.lit(1000)) + 1, F.pmod(replicate, F.lit(1000)) + 1
    h = F.pmod(k * 7919 + r * 104729 + k * r * 31, F.lit(1000))
    return F.when(h < POISSON[0], 0).when(h < POISSON[1], 1).when(h < POISSON[2], 2).when(h < POISSON[3], 3).otherwise(4)


def bootstrap_rate(df: DataFrame, key: str, hit: str, replicates: int) -> DataFrame:
    """Rate and its percentile interval over replicates; the replicates of a row are summed before any shuffle."""
    rows = df.select(key, F.col(hit).cast("long").alias("_hit"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    m = multiplicity(F.col(key), F.col("replicate"))
    rates = rows.groupBy("replicate").agg((F.sum(m * F.col("_hit")).cast("double") / F.sum(m)).alias("rate"))
    return rates.agg(
        fixed(F.percentile("rate", F.lit(0.025))).alias("low"),
        fixed(F.percentile("rate", F.lit(0.5))).alias("middle"),
        fixed(F.percentile("rate", F.lit(0.975))).alias("high"),
    )


def leave_one_group_out(df: DataFrame, features: list[str], label: str, group: str, key: str, kind: str = "logistic", seed: int = 7, trees: int = 500) -> DataFrame:
    """(key, group, label, score): each group scored by a model of all others.

    The forests of all groups grow in the same passes; each tree is balanced on its
    own sample.  A logistic model is a fit for each group, of which there are few by
    design, with classes weighted to balance.
    """
    rows = df.select(key, group, F.col(label).cast("double").alias("label"), *(F.col(f).cast("double").alias(f) for f in features))
    if kind == "forest":
        model = forest.fit(rows, features, "label", key, group, trees, seed=seed)
        return forest.score(rows, model, group).select(key, group, "label", "score")
    return _logistic_by_group(rows, features, group, key)


def _logistic_by_group(rows: DataFrame, features: list[str], group: str, key: str) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = None
    for g in [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]:
        train = rows.filter(F.col(group) != g)
        n, p = train.agg(F.count(F.lit(1)), F.sum("label")).first()
        if not p or p == n:
            part = rows.filter(F.col(group) == g).select(key, group, "label", F.lit(p / n if n else None).alias("score"))
        else:
            weighted = train.withColumn("_w", F.when(F.col("label") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))))
            assembler = VectorAssembler(inputCols=features, outputCol="_raw")
            scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
            model = LogisticRegression(featuresCol="_x", weightCol="_w", regParam=1 / n, standardization=False)
            fitted = Pipeline(stages=[assembler, scaler, model]).fit(weighted)
            scored = fitted.transform(rows.filter(F.col(group) == g))
            part = scored.select(key, group, "label", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


#: Factors of the permutations of row numbers; each is prime, so it has no divisor in common with fewer rows.
DEALING = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121, 1000133, 1000151)


def dealt_number(row: Column, repeat: Column, n: int) -> Column:
    """The number of the row whose value a row gets: another permutation of 0 to n-1 for each repeat."""
    factor = F.element_at(F.array(*map(F.lit, DEALING)), (F.pmod(repeat, F.lit(len(DEALING))) + 1).cast("int"))
    big = F.lit(max(1, n)).cast("decimal(38,0)")
    number = row.cast("decimal(19,0)") * factor.cast("decimal(10,0)") + (repeat + 1) * 7919
    # a number of rows that a factor divides would not be permuted; then rows are only turned
    turned = (row + repeat + 1).cast("decimal(38,0)")
    return F.when(F.lit(max(1, n)) % factor != 0, F.pmod(number.cast("decimal(38,0)"), big)).otherwise(F.pmod(turned, big)).cast("long")


def permutation_importance(df: DataFrame, columns: list[str], key: str, scorer: Callable[[DataFrame], DataFrame], label: str, repeats: int = 10) -> DataFrame:
    """Loss of average precision and of ROC AUC when a column's values are dealt anew, by column, as means over repeats.

    ``scorer`` adds the column ``score`` to rows: a fitted model, or an expression.
    Rows are numbered once, in the order of ``key``, over ranges; each repeat deals the
    values by a permutation of the numbers, all columns and repeats in one join by number.
    """
    rows, n = numbered(df, [F.col(key)], "_row")
    measures = ["average_precision", "roc_auc"]
    base = ranking_measures(scorer(rows), label, "score").select(*(F.col(m).alias(f"_{m}") for m in measures))
    turns = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    asked = rows.withColumn("repeat", turns).withColumn("column", F.explode(F.array(*map(F.lit, columns))))
    asked = asked.withColumn("_from", dealt_number(F.col("_row"), F.col("repeat"), n))
    values = rows.select(F.col("_row").alias("_from"), *(F.col(c).alias(f"_v_{c}") for c in columns))
    dealt = asked.join(values, "_from")
    for c in columns:
        dealt = dealt.withColumn(c, F.when(F.col("column") == c, F.col(f"_v_{c}")).otherwise(F.col(c)))
    per = ranking_measures(scorer(dealt), label, "score", ["column", "repeat"]).join(F.broadcast(base))
    return per.groupBy("column").agg(*(fixed(F.avg(F.col(f"_{m}") - F.col(m))).alias(f"loss_{m}") for m in measures))
