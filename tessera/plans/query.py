"""Registering a query next to the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from tessera.sources.tables import table


def registry() -> tuple[dict, dict[str, str], Callable]:
    """Queries, their SQL, and the decorator that fills both; without SQL a query is held against a brute-force version in the tests."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return put

    return queries, oracle, query


def sql_query(queries: dict, oracle: dict[str, str]) -> Callable:
    """Registers a query whose SQL both engines read as it is: `{name}` stands for a table."""

    def put(name: str, sql: str, about: str) -> None:
        tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))

        def run(spark, sf_dir):
            return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})

        run.__name__, run.__doc__ = name, about
        queries[name] = run
        oracle[name] = sql.format(**{t: t for t in tables})

    return put
