"""Registry of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantlens import views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = ""):
    """Register a function (spark, sf_dir) -> DataFrame by its name, with SQL over the named views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, uses)
        return f

    return register


def with_views(sql: str, uses: str) -> str:
    parts = [f"{name} as ({views.SQL[name]})" for name in uses.split()]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join([*parts, body[5:]])
    return ("with " + ", ".join(parts) + " " if parts else "") + body


def r6(c: str | Column) -> Column:
    return F.round(c, 6)
