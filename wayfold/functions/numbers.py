"""Numbers from text, and numbers that compare equal across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value" in tabular exports.
SENTINELS = ("", "-", "null")


def number(text: Column) -> Column:
    """A double, or null if the text is null, blank or no number.  Zero stays zero."""
    return F.trim(text).try_cast("double")


def number_or_sentinel(text: Column) -> Column:
    """As :func:`number`, with the sentinels of exports as null too."""
    return F.when(~F.trim(text).isin(*SENTINELS), number(text))


def digits_of(text: Column) -> Column:
    """The digits of an identifier."""
    return F.regexp_replace(text, r"\D", "")


def station_id(text: Column) -> Column:
    """Digits; a three-digit station gets a leading 1."""
    d = digits_of(text)
    return F.when(F.length(d) <= 3, F.concat(F.lit("1"), F.lpad(d, 3, "0"))).otherwise(d)


def fixed(x: Column, digits: int = 4) -> Column:
    """Half-up rounding that other engines repeat bit by bit; null stays null."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` as a fixed number, null for an empty whole."""
    return fixed(part.cast("double") / F.when(whole > 0, whole).cast("double"), digits)


def cents(money: Column) -> Column:
    """Money as whole cents, whose sums don't depend on the order."""
    return F.floor(money * F.lit(100.0) + F.lit(0.5)).cast("long")


def count_of(condition: Column) -> Column:
    """How many rows meet a condition; null does not."""
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")
