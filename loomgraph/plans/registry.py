"""Registry of the named queries over the driver tables, each with its oracle SQL.

A plan module registers a query with :func:`query`; the operators themselves
know nothing about table directories.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES: tuple[str, ...] = ("flagship", "statistics", "graphs", "scopes", "retrieval", "answers", "building", "extras", "reports", "trust", "wording", "contexts", "inventory", "audit", "records", "grounding", "searching", "entity_first", "files", "coreference", "parsing", "evidence")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a (spark, sf_dir) function under a name, with SQL if there is any."""

    def keep(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if oracle:
            _ORACLES[name] = oracle
        return function

    return keep


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"loomgraph.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
