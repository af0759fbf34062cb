"""Queries by name, and their SQL."""

from __future__ import annotations


class Catalogue:
    """Queries by name, and the SQL of those that have one."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
