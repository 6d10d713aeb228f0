"""Registry of runnable queries: name -> (Spark callable, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.registry.views import duck
from fieldlake.session import SETTINGS, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)``; without SQL the query is checked by tests/ instead."""
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)
            ship(spark)
            return f(spark, sf.rstrip("/"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck(sql)
        return f
    return add


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Round floating columns for the comparison; operators themselves never round."""
    exact = [n for n in names if dict(df.dtypes)[n] != "double"]
    return df.withColumns({n: F.round(n, digits) if n in exact else _rounded_double(F.col(n), digits) for n in names})


def _rounded_double(value: Column, digits: int) -> Column:
    """``round`` to the last bit without its decimals, except close to a half and for large values, where they decide.

    Below 1e11 the product is off by far less than the 1e-4 left around a half, and a whole number over a power of ten is the double
    nearest to that decimal.
    """
    power = F.lit(10.0 ** digits)
    whole = F.rint(value * power)
    plain = (F.abs(whole) < 1e11) & (F.abs(value * power - whole) < 0.4999)
    return F.when(plain, whole / power + F.lit(0.0)).otherwise(F.round(value, digits))
