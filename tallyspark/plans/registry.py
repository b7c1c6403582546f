"""Query registry: every operator of the inventory as a query over the test tables.

``register(name, sql)`` stores the Spark builder ``(spark, sf_dir) -> DataFrame``
and, when given, the equivalent SQL run by the DuckDB oracle.  Column names are
aliased identically in both.  Computed doubles are rounded to 6 decimals in
both so float summation order cannot change a value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def money_sum(c) -> Column:
    """Exact sum of a 2-decimal money column (decimal accumulation, double result)."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def load_all() -> None:
    from . import (q_aggregates, q_derived, q_graph, q_joins, q_models, q_projections,  # noqa: F401
                   q_scalar, q_streaming, q_windows)
    from . import q_extras, q_histories, q_users  # noqa: F401  (use the loaded oracle strings)
