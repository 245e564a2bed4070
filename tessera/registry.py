"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import expose_package

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows."""

    def register(f):
        if f.__name__ in REGISTRY:
            raise ValueError(f"{f.__name__} is registered already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            expose_package(spark)
            return f(spark, sf_dir)

        run.__name__ = f.__name__
        REGISTRY[f.__name__] = (run, sql)
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
