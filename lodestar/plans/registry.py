"""Registration of queries with their SQL."""

from __future__ import annotations

from ..sources.views import with_views


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None, *views: str):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = with_views(sql, *views) if views else sql
            return f

        return keep
