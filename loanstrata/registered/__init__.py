"""Named queries over the supplied tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query
    return add


def load_all() -> None:
    from loanstrata.registered import (  # noqa: F401
        cleaning, drift, edges, features, loss, metrics, models, profiling, registry, streams, tournament,
    )
