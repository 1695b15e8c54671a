"""Query catalogue: name -> Spark job, name -> DuckDB oracle SQL.

Plan modules register their queries with ``@query(name, oracle=...)``.
A query with no oracle is checked on row counts only by the driver and
against a brute-force reference in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that their queries register."""
    import importlib
    for mod in PLAN_MODULES:
        importlib.import_module(f"matfold.plans.{mod}")


PLAN_MODULES = ["corrosion", "materials", "assays", "polymers", "search", "joins", "crystals", "features", "schema_ops", "models"]
