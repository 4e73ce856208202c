"""Registry of named queries: Spark callable + optional DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    check: str  # "E" exact, "R" rounded, "P" property test + rows only


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, check: str = "E") -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, oracle, check)
        return fn
    return deco
