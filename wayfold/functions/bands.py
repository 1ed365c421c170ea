"""Width verdicts.  A missing width is a status of its own, never a number.

A verdict says that a width can't be accepted on the data at hand; it does not
say that a road is impassable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the bands in metres, the reach of the measuring error, vehicle classes.
BLOCKED_UP_TO, CONDITIONAL_UP_TO = 2.5, 3.5
UNCERTAINTY = 0.48
CLASS_WIDTHS = (1.9, 2.2, 2.5)
SPACE_MARGIN, BLOCK_MARGIN = 1.2, 2.0
UNKNOWN = "UNKNOWN_FAIL_CLOSED"
RANKS = {"CANDIDATE_PASS": 3, "CONDITIONAL_C": 2, "BLOCKED": 1, "BLOCKED_C": 1, UNKNOWN: 0}


def band(width: Column) -> Column:
    return (
        F.when(width.isNull(), UNKNOWN)
        .when(width <= BLOCKED_UP_TO, "BLOCKED")
        .when(width <= CONDITIONAL_UP_TO, "CONDITIONAL_C")
        .otherwise("CANDIDATE_PASS")
    )


def band_with_error(width: Column) -> Column:
    return (
        F.when(width.isNull(), UNKNOWN)
        .when(width + UNCERTAINTY < CONDITIONAL_UP_TO, "BLOCKED_C")
        .otherwise("CONDITIONAL_C")
    )


def band_and_reason(width: Column) -> Column:
    """The band, and why there is none."""
    known = width.isNotNull() & (width > 0)
    return F.struct(
        F.when(known, band(width)).otherwise("WIDTH_UNKNOWN").alias("band"),
        F.when(width.isNull(), "no width").when(width <= 0, "width not positive").alias("reason"),
    )


def class_width(width: Column, classes: tuple[float, ...] = CLASS_WIDTHS) -> Column:
    """The largest class that is not wider; null if none is."""
    return F.array_max(F.filter(F.array(*map(F.lit, classes)), lambda x: x <= width))


def separation(width: Column, classes: tuple[float, ...] = CLASS_WIDTHS) -> Column:
    """How vehicles and people are kept apart: mode, and whether the road is closed meanwhile."""
    e = class_width(width, classes)
    return F.struct(
        F.when(width.isNull(), UNKNOWN)
        .when(e.isNull(), "impassable")
        .when(width >= e + SPACE_MARGIN, "space")
        .otherwise("time")
        .alias("mode"),
        F.when(width.isNull(), None).when(e.isNull() | (width < e + BLOCK_MARGIN), "Y").otherwise("N").alias("closed"),
    )


def slot_flags(width: Column, strict: bool = True, limits: tuple[float, ...] = (2.5, 3.7, 5.7)) -> list[Column]:
    """Whether one, two or three lanes of use fit."""
    return [F.coalesce(width > x if strict else width >= x, F.lit(False)) for x in limits]


def agreement(value: Column, low: Column, high: Column, slack: float = 1.0) -> Column:
    return (
        F.when(value.isNull() | low.isNull() | high.isNull(), "not comparable")
        .when((value >= low - slack) & (value <= high + slack), "consistent")
        .otherwise("different")
    )


def evidence_grade(agreeing: Column, compared: Column) -> Column:
    share = agreeing / F.when(compared > 0, compared)
    return F.when(share >= 0.8, "C").when(share >= 0.5, "D").when(share.isNotNull(), "E")


def rank_of(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[name]


def rank_change(before: Column, after: Column) -> Column:
    a, b = rank_of(before), rank_of(after)
    return (
        F.when(a.isNull() | b.isNull() | (a == 0) | (b == 0), "not comparable")
        .when(b > a, "raised")
        .when(b < a, "lowered")
        .otherwise("same")
    )


def final_width(missed: Column, *widths: Column) -> Column:
    """The least width there is, unless a detection was missed; with its basis."""
    least = F.least(*widths) if len(widths) > 1 else widths[0]
    basis = F.when(missed, "missed detection")
    for i, w in enumerate(widths):
        basis = basis.when(w == least, f"width {i + 1}")
    return F.struct(F.when(~missed, least).alias("width"), basis.otherwise("none").alias("basis"))


#: The irregular width bins in test order, as (label, upper edge, whether the edge is in).
WIDTH_BINS = [
    ("<=2", 2.0, True),
    ("2-3", 3.0, False),
    ("=3", 3.0, True),
    ("3-4", 4.0, True),
    ("4-6", 6.0, True),
    ("6-8", 8.0, True),
    ("8-12", 12.0, False),
    ("12-20", 20.0, False),
    ("20-40", 40.0, False),
]
BIN_LABELS = ["missing", "=0", *(b[0] for b in WIDTH_BINS), ">=40"]


def width_bin(width: Column) -> Column:
    out = F.when(width.isNull(), "missing").when(width == 0, "=0")
    for label, edge, closed in WIDTH_BINS:
        out = out.when(width <= edge if closed else width < edge, label)
    return out.otherwise(">=40")


def reasons(*texts: Column) -> Column:
    """Reasons in a fixed order, without the blank ones."""
    return F.concat_ws(" · ", *[F.nullif(t, F.lit("")) for t in texts])


def swept_width(width: Column, wheelbase: Column, overhang: Column, radius: Column) -> Column:
    """Width that a turning vehicle needs: from its inner rear wheel to its outer front corner.

    ``radius`` is that of the outer front wheel.
    """
    rear = F.sqrt(radius * radius - wheelbase * wheelbase)
    reach = wheelbase + overhang
    return F.sqrt(rear * rear + reach * reach) - rear + width
