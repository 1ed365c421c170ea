"""Road names: normal forms and tiers by suffix."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: The suffixes of the road tiers, the longest first, and the label of all others.
AVENUE, STREET, LANE, SIDE_LANE, OTHER = "대로", "로", "길", "번길", "기타"
#: Names that say there is none.
NO_NAME = ("", "-")
#: White space of any script, as Python's str.split() has it.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def compact(name: Column) -> Column:
    """Without white space; null is empty."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), WHITE, "")


@pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form, for which Spark has no function."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normal_name(name: Column) -> Column:
    """Composed, without parenthesised groups, without white space."""
    return compact(F.regexp_replace(nfc(F.coalesce(name, F.lit(""))), r"\([^)]*\)", ""))


def is_unnamed(normal: Column) -> Column:
    return F.coalesce(normal, F.lit("")).isin(*NO_NAME)


def tier4(name: Column, avenue: str = AVENUE, street: str = STREET, lane: str = LANE, other: str = OTHER) -> Column:
    """Avenue, street, lane or other, in this order; null is other."""
    return (
        F.when(name.endswith(avenue), avenue).when(name.endswith(street), street).when(name.endswith(lane), lane).otherwise(other)
    )


def tier5(name: Column, numbered: str = r"\d+번안?길$") -> Column:
    """Numbered lanes apart; an empty name has no tier."""
    return F.when(
        F.coalesce(name, F.lit("")) != "",
        F.when(name.rlike(numbered), SIDE_LANE)
        .when(name.endswith(AVENUE), AVENUE)
        .when(name.endswith(STREET), STREET)
        .when(name.endswith(LANE), LANE)
        .otherwise(OTHER),
    )


def tier5_by_suffix(name: Column) -> Column:
    """As :func:`tier5` with a plain suffix, and an empty name as other."""
    return (
        F.when(name.endswith(SIDE_LANE), SIDE_LANE)
        .when(name.endswith(AVENUE), AVENUE)
        .when(name.endswith(STREET), STREET)
        .when(name.endswith(LANE), LANE)
        .otherwise(OTHER)
    )


def first_containing(text: Column, labels: list[tuple[str, str]], unknown: str) -> Column:
    """The label of the first pattern in ``labels`` that the text contains, else the text, else ``unknown``."""
    out = None
    for part, label in labels:
        hit = F.contains(text, F.lit(part))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    rest = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(unknown)
    return rest if out is None else out.otherwise(rest)


def coded(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code itself."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(table[code], code)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def with_one_deleted(text: Column) -> Column:
    """The text and all texts that lack one of its characters: two texts within one edit share one."""
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
    )
    return F.array_distinct(F.concat(F.array(text), cut))


def road_of_address(address: Column) -> Column:
    """The road, with a numbered lane if there is one; null without a road."""
    pattern = r"(\S+?(?:대로|로|길))\s*(\d+번?길)?"
    road = F.concat(F.regexp_extract(address, pattern, 1), F.regexp_extract(address, pattern, 2))
    return F.nullif(road, F.lit(""))


def key_in_parentheses(text: Column) -> Column:
    """What stands in parentheses, else the whole text; without white space."""
    return compact(F.coalesce(F.nullif(F.regexp_extract(text, r"\(([^)]*)\)", 1), F.lit("")), text))
