"""Registration of named queries: the callable, its oracle SQL and the operator rows it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Family:
    """Queries of one module, in order of registration."""

    entries: dict[str, tuple[Query, str | None, tuple[str, ...]]] = field(default_factory=dict)

    def query(self, rows: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name as covering the inventory ``rows``, with oracle ``sql``."""

        def register(f: Query) -> Query:
            if f.__name__ in self.entries:
                raise ValueError(f"registered twice: {f.__name__}")
            self.entries[f.__name__] = (f, sql, tuple(rows.split()))
            return f

        return register

    @property
    def queries(self) -> dict[str, tuple[Query, str | None]]:
        return {name: (q, sql) for name, (q, sql, _) in self.entries.items()}

    @property
    def coverage(self) -> dict[str, tuple[str, ...]]:
        return {name: rows for name, (_, _, rows) in self.entries.items()}
