"""How a query is registered: a function over tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from girder.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers `q_name(tables) -> DataFrame` under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def picked(index: str, choices: Sequence[str | None]) -> str:
    """One of some strings by a whole number, in SQL that both engines read alike: for inputs, never for answers."""
    whens = " ".join(f"WHEN {k} THEN " + ("NULL" if c is None else f"'{c}'") for k, c in enumerate(choices))
    return f"CASE ({index}) % {len(choices)} {whens} END"


def values(rows: list[tuple], names: str) -> str:
    """Rows as an SQL table."""
    text = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {text}) AS {names}"
