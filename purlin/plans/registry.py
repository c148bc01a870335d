"""A module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from purlin.sources.views import plain_sql, run_sql

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None, more: dict[str, str] | None = None, frames: dict[str, Query] | None = None) -> None:
        """A query whose text Spark and the other engine share, but for ``frames``: names that Spark takes from an
        operator and the other engine from the text in ``more``."""
        self.queries[name] = lambda spark, sf: run_sql(spark, sf, text, **{n: f(spark, sf) for n, f in (frames or {}).items() if "{" + n + "}" in text})
        self.oracles[name] = plain_sql(oracle or text, **(more or {}))

    def operator(self, name: str, oracle: str | None, **more: str) -> Callable[[Query], Query]:
        """Register a function of (spark, sf_dir), checked against ``oracle``."""

        def add(query: Query) -> Query:
            self.queries[name] = query
            if oracle is not None:
                self.oracles[name] = plain_sql(oracle, **more)
            return query

        return add
