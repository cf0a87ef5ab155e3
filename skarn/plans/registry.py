"""Registered queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import DUCK

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The SQL with the views that it names in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in re.findall(r"\bv_\w+", text):
            if v in DUCK and v not in need:
                add(DUCK[v])
                need.append(v)

    add(sql)
    views = ", ".join(f"{v} AS ({DUCK[v]})" for v in need)
    if not views:
        return sql
    if m := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{views}, {sql[m.end():]}"
    return f"WITH {views} {sql}"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that must give the same rows."""

    def put(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return f

    return put
