"""Registry of named queries (Spark callables) and their DuckDB oracle SQL.

Every query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
given tables.  Array results are rendered as ``\\x1f``-joined strings plus a
size column so that results compare as plain scalars across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.fixture_sql import with_fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEP = "\x1f"


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_fx(sql)
        return fn
    return deco


def joined(col, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.array_join(c, SEP)
    return out.alias(name or (col if isinstance(col, str) else "joined"))


def r6(col, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6).alias(name or (col if isinstance(col, str) else "value"))


def load_all() -> None:
    """Import the modules that register queries."""
    from tessera.plans import (  # noqa: F401
        q_builders, q_dedup, q_eval, q_filters, q_io, q_recipes, q_retrieval, q_sampling, q_vectors,
    )
