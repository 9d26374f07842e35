"""A module's queries and SQL, filled by a decorator."""

from __future__ import annotations

from collections.abc import Callable


def declare() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def keep(fn: Callable) -> Callable:
            queries[fn.__name__] = fn
            if text:
                sql[fn.__name__] = text
            return fn

        return keep

    return queries, sql, query
