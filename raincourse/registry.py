"""Queries and, next to each, the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from raincourse.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand(sql: str) -> str:
    """Prefix ``sql`` with the stand-in views it names, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+\(*\s*([A-Za-z_]\w*)", text):
            if name in SQL_VIEWS and name not in needed:
                visit(SQL_VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed)
    text = sql.strip()
    if text.lower().startswith("with recursive "):
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text.lower().startswith("with "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"


def query(name: str, sql: str | None = None):
    """Register ``fn(views)`` under ``name`` with its SQL equivalent."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return register
