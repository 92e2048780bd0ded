"""Collects queries and their oracles under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, *covers: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, the operator rows it covers and, if any, its SQL."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep
