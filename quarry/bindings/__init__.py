"""Bindings of the operators to the driver tables: one Spark query and, where SQL can say
the same thing, one DuckDB oracle query per operator.

Each binding module fills a ``Registry``; ``all_queries`` / ``all_oracles`` merge them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import pin_utc, read_table

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.oracles: dict[str, str] = {}

    def query(self, key: str, oracle: str | None = None):
        def deco(fn: Callable[..., DataFrame]) -> QueryFn:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                pin_utc(spark)
                return fn(Tables(spark, sf_dir))

            run.__name__ = f"q_{key}"
            run.__doc__ = fn.__doc__
            if key in self.queries:
                raise KeyError(f"duplicate query key {key}")
            self.queries[key] = run
            if oracle is not None:
                self.oracles[key] = oracle.strip()
            return run

        return deco


class Tables:
    """Lazy access to the driver tables: ``t.orders``, ``t['lineitem']``; ``t.spark``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)


MODULES = ["flagship", "quality", "history", "summaries", "relational", "restate", "lineage",
           "catalog", "slo", "sinks", "streams", "privacy", "sources", "functions"]


def _modules():
    for m in MODULES:
        yield importlib.import_module(f"{__name__}.{m}")


def all_queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for mod in _modules():
        out.update(mod.REG.queries)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in _modules():
        out.update(mod.REG.oracles)
    return out
