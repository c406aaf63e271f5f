"""Registered queries: one per operator, over the shared test tables, with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depthspark.operators import scan
from depthspark.plans.fixtures import Tables, duckdb_sql
from depthspark.session import tune


def block_width(spark: SparkSession) -> int:
    """``spark.depthspark.width`` if set, else the library's length of a scan block, wherever Spark runs."""
    return int(spark.conf.get("spark.depthspark.width", str(scan.WIDTH)))


_BUILD: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its name."""
    def add(build: Callable[[Tables], DataFrame]):
        _BUILD[build.__name__] = build
        if sql is not None:
            _SQL[build.__name__] = duckdb_sql(sql)
        return build
    return add


def _runner(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(tune(spark), sf_dir, block_width(spark)))
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(build) for name, build in _BUILD.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from depthspark.plans.queries import access, billing, books, feeds, sources, tiers, usage  # noqa: F401
