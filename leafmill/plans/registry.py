"""Named queries and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans.carriers import carrier, carrier_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, over: str | tuple[str, ...] = (), sql: str | None = None) -> Callable:
    """Registers a function of carriers (DataFrames) as a query over a folder of tables."""
    names = (over,) if isinstance(over, str) else over

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[carrier(spark, sf_dir, n) for n in names])
        if sql:
            ORACLES[name] = carrier_sql(sql)
        return f

    return put
