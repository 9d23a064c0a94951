"""Sorts and top-k (T1-T5).  ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject:
each task keeps its own top k, so only k rows per task cross the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, ts: str, n: int, tie: str | None = None) -> DataFrame:
    """Newest ``n`` rows."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, measure: str, k: int, tie: str | None = None) -> DataFrame:
    """Top ``k`` by a measure."""
    order = [F.col(measure).desc()] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*order).limit(k)


def recent_pipelines(cards: DataFrame, n: int = 14, ts: str = "last_run_at", name: str = "dag_id") -> DataFrame:
    """Newest run first, pipelines without runs last, name as the tie-break."""
    return cards.orderBy(F.col(ts).desc_nulls_last(), F.col(name).asc()).limit(n)


def sorted_tables(tables: DataFrame) -> DataFrame:
    """T4: tables ordered by (layer, name)."""
    return tables.orderBy("layer", "name")


def newest_run_results(rule_results: DataFrame, keys=("dataset",)) -> DataFrame:
    """T5: all results of the newest run (per dataset), ordered by status.

    The newest run id per key is a ``max_by`` aggregation, then a semi join keeps its rows.
    """
    keys = list(keys)
    last = rule_results.groupBy(*keys).agg(F.max_by("run_id", F.struct("run_timestamp", "run_id")).alias("run_id"))
    return rule_results.join(last, keys + ["run_id"], "left_semi").orderBy(*keys, "status", "rule_name")
