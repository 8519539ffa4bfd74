"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.plans.check_views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``check`` is DuckDB SQL over the tables and :data:`VIEWS`."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = with_views(check)
        return fn

    return keep


def with_views(sql: str) -> str:
    """Put the views a check names, and those they name, in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in VIEWS and word not in needed:
                need(VIEWS[word])
                needed.append(word)

    need(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[len('WITH'):]}"
    return f"WITH {views}\n{body}"
