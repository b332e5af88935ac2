"""Named queries over the provided tables and the SQL that checks them.

A query is a function of carrier tables: domain tables (changed lines, coverage
blocks, runs, graph nodes and edges, ...) that ``carriers`` derives from the
provided ones. The oracle is DuckDB SQL over the same carriers.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridelta import carriers
from veridelta.session import ship

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "joi1_interval_cover"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as 64-bit, so that result schemas don't depend on how a value was computed."""
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*(F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, narrow) else F.col(f"`{f.name}`") for f in df.schema))


def query(name: str, sql: str | None = None, *, python: bool = False) -> Callable:
    """Register a function of carriers, named by its parameters, with DuckDB SQL over the same carriers.

    ``python``: whether executors run this package's code.
    """

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        wanted = list(inspect.signature(f).parameters)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if python:
                ship(spark)
            return widened(f(*(carriers.load(spark, sf_dir, c) for c in wanted)))

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = carriers.oracle(sql, wanted)
        return f

    return put


def _load() -> None:
    from veridelta import plans  # noqa: F401  (registers its queries on import)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
