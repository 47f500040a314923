"""Collects a module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from .views import with_views


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, *views: str) -> Callable:
        """Registers a function under its name; `sql` is DuckDB's text after the views."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = with_views(sql, *views)
            return f

        return add
