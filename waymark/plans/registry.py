"""Named queries over the given tables, each with the SQL that its result is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import SQL_TABLES

AS_OF = "1998-08-02"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir); sql may use the views of SQL_TABLES and `$as_of`."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            body = sql.strip().replace("$as_of", f"DATE '{AS_OF}'")
            more, body = body.split("-- main", 1) if "-- main" in body else ("", body)
            SQL[name or f.__name__] = f"WITH {SQL_TABLES.strip()}{', ' + more.strip() if more.strip() else ''}\n{body.strip()}"
        return f

    return add
