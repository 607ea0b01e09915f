"""The registered queries and the SQL that checks them.

Each module registers queries with `@query(name, oracle)`. A query takes the session and the
folder of the tables; the oracle is SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def load() -> None:
    """Import every module that registers queries."""
    from evenkeel.catalog import compare, diffs, digests, display, filters, schema, state, versions, workload  # noqa: F401
