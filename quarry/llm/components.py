"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(low, "a")
    if large:
        moved = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); the root is the component's smallest node."""
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "cc-0")
    mark = _mark(edges)
    while mark[0]:
        edges = stage(_star(stage(_star(edges, True), "cc-large"), False), "cc-small")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return stage(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "cc-roots")


def join_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more ``links`` (a, b): only the components they join are
    worked on; nodes not in ``roots`` are their own."""
    if not links.limit(1).count():
        return roots
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    ends = stage(ends, "cc-ends")
    up = stage(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "cc-up")
    nodes = roots.unionByName(ends.select(F.col("a").alias("node"), F.col("x").alias("root"))) \
        .unionByName(ends.select(F.col("b").alias("node"), F.col("y").alias("root"))).distinct()
    top = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stage(nodes.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-roots")
