"""A table of queries and their SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracle_sql = {}, {}

    def __call__(self, sql: str | None = None):
        """Registers the decorated function under its name, with the SQL that gives the same rows."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle_sql[f.__name__] = sql
            return f

        return add
