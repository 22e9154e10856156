"""The registry of queries: name -> (spark, sf_dir) -> DataFrame, and the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; ``sql`` may use the event tables and must select the same columns."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            more, _, select = sql.rpartition("SELECT::")
            ORACLE[f.__name__] = f"WITH {ev.SQL}{',' if more.strip() else ''} {more} SELECT {select}" if "SELECT::" in sql else sql
        return f

    return register
