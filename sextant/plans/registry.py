"""A small registry: each module of plans lists its queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """queries, oracle and a decorator that adds a query under its name, with SQL if there is any."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
