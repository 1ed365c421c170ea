"""Addresses of road pieces: splitting lists, inheriting stems, kinds and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that end a piece without being part of its name.
TRAILING = ("일원", "일대", "구간", "주변")


def pieces(df: DataFrame, key: str, address: str) -> DataFrame:
    """One row for each road of a listed address: (key, pos, piece).

    Parentheses go, the text is cut at ``~``, ``,`` and ``/``, a trailing area word
    and a leading district go, and a name apart from its numbered lane is
    joined.  A piece that is only a numbered lane takes the stem of the last
    piece before it that has one.
    """
    text = F.regexp_replace(F.coalesce(address, F.lit("")), r"\([^)]*\)", "")
    rows = df.select(key, F.posexplode(F.split(text, r"[~,/]")).alias("pos", "_p"))
    p = F.trim(F.regexp_replace("_p", r"\s+", " "))
    p = F.trim(F.regexp_replace(p, "(" + "|".join(TRAILING) + ")$", ""))
    p = F.regexp_replace(p, r"^\S+[구군]\s+", "")
    p = F.regexp_replace(p, r"(로|길)\s+(\d+번?길)", "$1$2")
    rows = rows.withColumn("_p", p).filter("_p <> ''")
    bare = F.regexp_like("_p", F.lit(r"^\d+번?길$"))
    stem = F.when(~bare, F.nullif(F.regexp_extract("_p", r"^(.*?(?:대로|로))", 1), F.lit("")))
    inherited = F.last(stem, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, "pos", F.when(bare, F.concat(F.coalesce(inherited, F.lit("")), F.col("_p"))).otherwise(F.col("_p")).alias("piece"))


def kind(piece: Column) -> Column:
    """Whether an address names a parcel or a road."""
    return F.when(F.regexp_like(piece, F.lit(r"(동|리|가)\s*(산\s*)?\d+(-\d+)?$")), "parcel").otherwise("road")


def accepted(asked: Column, answer: Column) -> Column:
    """Whether the words after the district of a geocoder's answer begin with the road that was asked for."""
    rest = F.regexp_extract(answer, r"[구군]\s+(.*)$", 1)
    return F.split_part(rest, F.lit(" "), F.lit(1)) == asked


def elapsed_verdict(seconds: Column, limit: float = 300.0) -> Column:
    return F.when(seconds.isNull(), "not measured").when(seconds <= limit, "usable").otherwise("too slow")
