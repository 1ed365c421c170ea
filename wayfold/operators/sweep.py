"""Sensitivity sweeps: the same rows under many settings, in one plan."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.numbers import count_of, fixed

BUFFER_FACTORS = (0.8, 0.9, 1.0, 1.1, 1.2)


@dataclass(frozen=True)
class VehicleOutline:
    """Limits of an outline that may be a vehicle's; the defaults are fixed values, in square metres, metres and ratios."""

    least_area: float = 3.0
    most_area: float = 20.0
    least_length: float = 3.0
    most_length: float = 7.5
    least_width: float = 1.4
    most_width: float = 2.8
    least_ratio: float = 1.6
    most_ratio: float = 4.2
    least_fill: float = 0.62

    def met(self) -> Column:
        """Whether a row's area A, length L, width S, L to S and fill R lie within the limits; never null."""
        ratio = F.col("L") / F.nullif(F.col("S"), F.lit(0.0))
        area = F.col("A").between(self.least_area, self.most_area)
        long = F.col("L").between(self.least_length, self.most_length)
        wide = F.col("S").between(self.least_width, self.most_width)
        slender = ratio.between(self.least_ratio, self.most_ratio)
        return F.coalesce(area & long & wide & slender & (F.col("R") >= self.least_fill), F.lit(False))


def outline_settings(share: float = 0.1) -> dict[str, VehicleOutline]:
    """The limits of one measure at a time moved down and up by a share."""
    base, out = VehicleOutline(), {}
    for measure in ("area", "length", "width", "ratio", "fill"):
        own = [f.name for f in fields(base) if f.name.endswith(measure)]
        for factor in (1 - share, 1 + share):
            out[f"{measure} x{factor:g}"] = replace(base, **{name: factor * getattr(base, name) for name in own})
    return out


def vehicle_sweep(df: DataFrame, stored: str, share: float = 0.1) -> DataFrame:
    """The sweep of a stored verdict over the settings: see :func:`sweep` and :func:`flipped`."""
    base = VehicleOutline().met()
    settings = {"base": VehicleOutline()} | outline_settings(share)
    rules = {name: flipped(F.col(stored), base, outline.met()) for name, outline in settings.items()}
    return sweep(df, rules, F.col(stored))


def flipped(stored: Column, base: Column, perturbed: Column) -> Column:
    """The stored flag, changed only where the perturbed rule and the base rule differ on the stored values."""
    return stored != (base != perturbed)


def sweep(df: DataFrame, settings: dict[str, Column], base: Column) -> DataFrame:
    """For each setting: rows that meet it, rows whose verdict it changes, and the unchanged share in percent.

    All settings are evaluated in one pass over the rows and one aggregation.
    """
    counts = []
    for i, rule in enumerate(settings.values()):
        counts += [count_of(rule).alias(f"s{i}"), count_of(rule != base).alias(f"c{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *counts)
    rows = F.array(*(F.struct(F.lit(name).alias("setting"), F.col(f"s{i}").alias("n_spec"), F.col(f"c{i}").alias("n_changed")) for i, name in enumerate(settings)))
    tall = one.select("n", F.explode(rows).alias("r")).select("r.*", "n")
    same = F.lit(100) * (F.col("n") - F.col("n_changed")).cast("double") / F.when(F.col("n") > 0, F.col("n"))
    return tall.select("setting", "n_spec", "n_changed", fixed(same).alias("invariance"))


def near_limits(df: DataFrame, value: str, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose value lies within a tolerance of a limit, tagged with the limit."""
    v = F.col(value)
    sides = F.array_compact(F.array(*(F.when(F.abs(v - limit) <= tol, name) for name, (limit, tol) in limits.items())))
    return df.withColumn("side", F.explode(sides))


def ratio_tolerance(a: Column, b: Column, half_step: float) -> Column:
    """How far a / b can be off if a and b are each rounded to a step."""
    return F.abs(a / b) * (half_step / F.abs(a) + half_step / F.abs(b))


def stand_in_settings() -> list[tuple[str, float, float, float]]:
    """15 settings of three limits."""
    out = [("base", 10.0, 30.0, 0.05)]
    for f in (0.8, 0.9, 0.95, 1.05, 1.1, 1.2):
        out.append((f"quantity x{f:g}", 10.0 * f, 30.0 * f, 0.05))
    for d in (0.01, 0.02, 0.03, 0.04, 0.06, 0.07, 0.08, 0.09):
        out.append((f"discount {d:g}", 10.0, 30.0, d))
    return out


def stand_in(lines: DataFrame) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    rules = {name: q.between(q0, q1) & (d <= d1) for name, q0, q1, d1 in stand_in_settings()}
    return sweep(lines, rules, q.between(10, 30) & (d <= 0.05))
