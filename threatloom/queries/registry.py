"""Collects queries and SQL twins of one module."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def register(run):
            self.queries[name] = run
            if sql:
                self.oracles[name] = sql
            return run
        return register
