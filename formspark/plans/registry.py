"""Collects the queries of every family."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = ["text_queries", "classify_queries", "json_queries", "rule_queries", "join_queries", "group_queries", "layout_queries", "score_queries", "assemble_queries", "assign_queries"]


class Family:
    """One family: queries by name, with the SQL that must give the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn
        return register


def families() -> list[Family]:
    return [importlib.import_module(f"formspark.plans.{name}").family for name in FAMILIES]


def queries() -> dict[str, Query]:
    return {name: fn for f in families() for name, fn in f.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for f in families() for name, sql in f.sql.items()}
