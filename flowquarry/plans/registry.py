"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query; ``sql`` is the same question for another engine, or None where SQL can't put it."""

        def add(run: Query) -> Query:
            if name in self.entries:
                raise ValueError(f"{name} is registered twice")
            self.entries[name] = Entry(name, run, sql)
            return run

        return add

    def queries(self) -> dict[str, Query]:
        return {k: e.run for k, e in self.entries.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {k: e.sql for k, e in self.entries.items() if e.sql}


REGISTRY = Registry()
query = REGISTRY.query
