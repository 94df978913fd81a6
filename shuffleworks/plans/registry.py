"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str) -> Callable[[Query], Query]:
        """Register a query under its function name, with its SQL."""

        def add(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            self.sql[fn.__name__] = sql
            return fn

        return add
