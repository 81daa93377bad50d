"""Named queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import CTE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, base: str | None = None, sql: str | None = None):
    """Register a query. ``base`` names the fixture expressions that precede ``sql``.

    ``sql`` is either a bare SELECT or further expressions followed by one, beginning
    with a comma.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = (f"WITH {CTE[base]}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if base else sql)
        return fn

    return register
