"""Registration of queries and of the SQL used to check them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its check SQL if there is one."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        from framelens.workload.views import Tables

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            ORACLES[name] = text if text.split()[0].upper() in ("SELECT", "WITH") else "WITH " + text
        return fn
    return wrap
