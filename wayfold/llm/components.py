"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.workspace import Workspace


def components(edges: DataFrame, work: Workspace, label: str) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in an edge (a, b).

    Each round every vertex points at its smallest neighbour, pointers are
    followed to their ends by doubling, and the edges are contracted.  At
    least half of the vertices go in a round, and chains cost a logarithm.
    Every step is a join or an aggregation, written down before the next.
    """
    spark = work.spark
    links = work.table(edges.select("a", "b").filter("a <> b").distinct(), f"{label}-edges", small=True)
    result, k = None, 0
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("up"))
        up = work.table(up, f"{label}-{k}-up-0", small=True)
        jump = 0
        while True:
            above = up.select(F.col("id").alias("up"), F.col("up").alias("above"))
            step = up.join(above, "up").select("id", "up", "above")
            if step.filter("above < up").isEmpty():
                break  # stars, as most groups of copies are, end here at once
            jump += 1
            up = work.table(step.select("id", F.col("above").alias("up")), f"{label}-{k}-up-{jump}", small=True)
        if result is None:
            result = up.select("id", F.col("up").alias("component"))
        else:
            higher = up.select(F.col("id").alias("component"), "up")
            result = result.join(higher, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
            result = work.table(result, f"{label}-{k}-result", small=True)
        a, b = up.select(F.col("id").alias("a"), F.col("up").alias("ra")), up.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        links = links.join(a, "a").join(b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        if links.isEmpty():
            break
        k += 1
        links = work.table(links.distinct(), f"{label}-{k}-contracted", small=True)
    return result if result is not None else spark.createDataFrame([], "id long, component long")
