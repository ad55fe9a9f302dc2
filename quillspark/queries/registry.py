"""A decorator that registers a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registrar(queries: dict, sql: dict) -> Callable:
    def query(oracle: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[f.__name__] = f
            if oracle is not None:
                sql[f.__name__] = oracle
            return f

        return keep

    return query
