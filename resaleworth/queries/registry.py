"""Registration of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.checks: dict[str, str] = {}

    def __call__(self, check: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name, with the SQL that gives the same rows if there is one."""

        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if check is not None:
                self.checks[fn.__name__] = check
            return fn

        return register
