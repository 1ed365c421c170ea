"""Text: tokens of claims, contexts, terms, markup, layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"


def numbers_in(text: Column) -> Column:
    """Numbers that no digit, point or comma of another number touches."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![\d.,])({NUMBER})(?![\d])"), 1)


def numbers_with_unit(text: Column, units: list[str]) -> Column:
    """Numbers or ranges that a unit follows; the unit is looked at, not taken."""
    unit = "|".join(units)
    return F.regexp_extract_all(text, F.lit(rf"({NUMBER}(?:\s*[~–-]\s*{NUMBER})?)(?=\s*(?:{unit}))"), 1)


def holds_number(text: Column, number: Column) -> Column:
    """Whether a number stands in a text without a digit next to it."""
    pattern = F.concat(F.lit(r"(?<![\d.])"), F.regexp_replace(number, r"([.])", r"\\$1"), F.lit(r"(?!\d)"))
    return F.regexp_like(text, pattern)


def citations(text: Column) -> Column:
    """Marks such as [3]."""
    return F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1)


def context(text: Column, position: Column, size: Column, reach: int) -> Column:
    """A match with up to ``reach`` characters on both sides; positions count from 1."""
    start = F.greatest(F.lit(1), position - reach)
    return F.substring(text, start, position - start + size + reach)


def thousands(x: Column, digits: int = 0) -> Column:
    return F.format_number(x, digits)


def without_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, "<[^>]+>", "")


def tag_count(markup: Column, tag: str) -> Column:
    return F.regexp_count(markup, F.lit(rf"<{tag}\b")).cast("long")


def display_width(text: Column, narrow: float = 0.55) -> Column:
    """Width in wide characters: ASCII is narrow."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return wide + (F.length(text) - wide) * F.lit(narrow)


def wrapped_lines(text: Column, width: int) -> Column:
    """Lines that a greedy wrap at spaces makes; a longer word has lines of its own."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"))

    def place(acc: Column, word: Column) -> Column:
        size = F.length(word)
        fits = (acc["used"] > 0) & (acc["used"] + 1 + size <= width)
        rows = F.greatest(F.lit(1), F.ceil(size / F.lit(float(width))).cast("int"))
        return F.struct(
            F.when(fits, acc["n"]).otherwise(acc["n"] + rows).alias("n"),
            F.when(fits, acc["used"] + 1 + size).otherwise(size - (rows - 1) * width).cast("int").alias("used"),
        )

    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.aggregate(words, start, place, lambda acc: acc["n"])


def column_widths(widths: Column, total: float, least: float = 12.0, power: float = 0.6) -> Column:
    """Shares of ``total`` in proportion to a power of each width, none under ``least``; the last one takes what is left."""
    weight = F.transform(widths, lambda w: F.pow(F.greatest(w, F.lit(1.0)), F.lit(power)))
    whole = F.aggregate(weight, F.lit(0.0), lambda a, w: a + w)
    shares = F.transform(weight, lambda w: F.greatest(F.lit(least), F.floor(w / whole * F.lit(total))).cast("double"))
    head = F.slice(shares, F.lit(1), F.size(shares) - 1)
    rest = F.lit(total) - F.aggregate(head, F.lit(0.0), lambda a, w: a + w)
    return F.concat(head, F.array(F.greatest(F.lit(least), rest)))


def filled_in(text: Column, name: str, value: str | None) -> Column:
    """A placeholder's value, or a mark that shows that there is none."""
    return F.replace(text, F.lit("{" + name + "}"), F.lit(value if value else f"[{name} not set]"))
