"""Table of registered queries: name -> (Spark function, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from parcelgrid.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(fixtures) -> DataFrame``; ``oracle`` is SQL over the fixture views."""

    def add(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add


def r4(column, name: str):
    """Four decimals, as the oracles round too; ``+ 0.0`` turns a negative zero into zero."""
    from pyspark.sql import functions as F

    return (F.round(column, 4) + F.lit(0.0)).alias(name)
