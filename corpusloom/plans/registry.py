"""Where queries and their SQL are registered, and small helpers that their plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..session import LINE, tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
ALL = ", ".join(LINE)


def query(sql: str | None = None):
    """Registers a plan over a data folder's tables by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def n(column="*"):
    return F.count(column)


def long(column):
    return F.col(column).cast("long") if isinstance(column, str) else column.cast("long")
