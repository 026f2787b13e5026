"""Registry of the checked queries: name -> (Spark builder, DuckDB SQL twin).

A query reads the driver tables under ``sf_dir`` (or data Spark derives from
them) and returns a lazy DataFrame.  Its SQL twin is the oracle: the same
result written as plain SQL over the same tables (omitted where the result is
not SQL-expressible, e.g. Spark ML models or streams).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: register a query builder and its SQL twin."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    from tamis.plans import (  # noqa: F401
        q_clean, q_corrupt, q_drift, q_eval, q_features, q_io, q_models, q_monitor, q_profile,
        q_repair, q_sampling, q_stream, q_text,
    )
