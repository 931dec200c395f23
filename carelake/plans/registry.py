"""Query registry: name -> callable(spark, sf_dir) -> DataFrame, plus SQL oracles.

Each entry builds the curated layer lazily from the driver's tables and applies one
operator; nothing is collected. Names follow SURVEY section 2 ("q" keys).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carelake.sources.fixtures import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Serving mode (opt-in): the curated facts of a table folder are derived once per session and
# persisted (MEMORY_AND_DISK, lineage kept), like a warehouse serving many queries from
# one curated layer. Off by default: each query then derives its inputs from the tables.
_SERVING: dict = {"on": False, "lakes": {}}


def serving_mode(on: bool = True) -> None:
    _SERVING["on"] = on


def lake_of(spark: SparkSession, sf_dir: str) -> Lake:
    if not _SERVING["on"]:
        return Lake.from_testdata(spark, sf_dir)
    key = (id(spark), sf_dir)
    if key not in _SERVING["lakes"]:
        from pyspark import StorageLevel
        lake = Lake.from_testdata(spark, sf_dir)
        lake.tables = {n: df.persist(StorageLevel.MEMORY_AND_DISK) for n, df in lake.tables.items()}
        _SERVING["lakes"][key] = lake
    return _SERVING["lakes"][key]


def register(name: str):
    """Decorator for ``fn(lake) -> DataFrame`` operators."""
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: _fn(lake_of(spark, sf_dir))
        return fn
    return deco


def register_raw(name: str):
    """Decorator for ``fn(spark, sf_dir) -> DataFrame`` (queries over non-curated tables)."""
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def all_queries() -> dict:
    import carelake.plans.queries  # noqa: F401  (registers)
    return dict(QUERIES)


def all_oracles() -> dict:
    from carelake.oracle import catalog_sql
    return catalog_sql.all_sql()
