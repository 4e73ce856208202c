"""Registered queries of this package: name -> (function, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, oracle)
        return fn
    return deco
