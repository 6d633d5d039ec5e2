"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from ..functions.shipping import ship
from ..sources.canonical import oracle

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None):
    """Registers a query under its function's name; `sql` runs over the canonical tables named in `tables`."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(tables, sql)
        return f

    return add
