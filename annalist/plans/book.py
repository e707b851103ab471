"""A list of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Enter a function under its name, with the SQL that must give the same rows."""

        def enter(query: Callable) -> Callable:
            self.queries[query.__name__] = query
            if sql:
                self.oracle[query.__name__] = sql
            return query

        return enter
