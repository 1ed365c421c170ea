"""Registry of queries over the driver's tables, each with the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name; without ``sql`` it is tested otherwise."""

    def register(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def fx(expression: str, digits: int = 4) -> str:
    """SQL of :func:`wayfold.functions.numbers.fixed`."""
    return f"floor(({expression}) * 1e{digits} + 5e-1) / 1e{digits}"


def ratio(part: str, whole: str, digits: int = 4) -> str:
    """SQL of :func:`wayfold.functions.numbers.rate`."""
    return fx(f"CAST({part} AS DOUBLE) / CAST(CASE WHEN ({whole}) > 0 THEN ({whole}) END AS DOUBLE)", digits)


def n_if(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"
