"""Lineage graph operators.

Traversals are iterative joins of a frontier with the edge table.  Each hop is one join plus
an anti join against the visited set; every ``checkpoint_every`` hops the visited set is cut
with a reliable checkpoint (shared checkpoint folder), so plans do not grow with depth.
The loop stops when the frontier is empty, or at a depth the caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalar import tag_value
from ..session import cut_lineage


def edges_from_tags(pipelines: DataFrame, key: str = "dag_id", tags: str = "tags") -> DataFrame:
    """L1: edges ``source -> output`` of every pipeline from its ``source:``/``output:`` tags
    (lower-cased); one explode and a self join on the pipeline key."""
    t = pipelines.select(key, F.explode(tags).alias("tag"))
    src = t.select(key, tag_value(F.col("tag"), "source").alias("src")).filter(F.col("src").isNotNull())
    dst = t.select(key, tag_value(F.col("tag"), "output").alias("dst")).filter(F.col("dst").isNotNull())
    return src.join(dst, key).select("src", "dst").distinct()


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    if direction == "downstream":
        return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if direction == "upstream":
        return edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    raise ValueError("direction is 'upstream' or 'downstream'")


def _cols(df: DataFrame, prefix: str) -> list:
    return [F.col(c).alias(f"{prefix}{c}") for c in df.columns]


def walk(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, checkpoint_every: int = 3) -> DataFrame:
    """Nodes reachable from ``starts`` with their shortest depth, 0 for the starts themselves.

    ``starts`` has the node's columns; ``edges`` has the same columns twice, as ``a_..`` and
    ``b_..``.  Breadth-first: a node is kept at the first hop that reaches it, so cycles end.
    Without ``max_depth`` the walk goes on until a hop finds nothing new.
    """
    names = starts.columns
    e = cut_lineage(edges.distinct())  # read once per hop
    frontier = cut_lineage(starts.distinct())
    visited, d = frontier.withColumn("depth", F.lit(0)), 0
    while max_depth is None or d < max_depth:
        d += 1
        found = Observation()
        step = (frontier.select(*_cols(frontier, "a_")).join(e, [f"a_{c}" for c in names])
                .select(*[F.col(f"b_{c}").alias(c) for c in names]).distinct()
                .join(visited.select(*names), names, "left_anti"))
        step = cut_lineage(step.observe(found, F.count(F.lit(1)).alias("n")))
        if not found.get["n"]:
            break
        visited = visited.unionByName(step.withColumn("depth", F.lit(d)))
        if d % checkpoint_every == 0:
            visited = cut_lineage(visited)
        frontier = step
    return visited


def heads(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(node, head, dist) of every node with exactly one parent: the nearest ancestor that has another number of
    parents or is in ``stops`` (``node``), and how far it is.

    By pointer jumping: in each round a node takes over its ancestor's pointer, so distances double and a
    chain or tree of depth d takes about log2(d) rounds.  ``edges`` has ``a``, ``b``, distinct.  A ring that nothing
    enters has no head: its nodes get head NULL.
    """
    one = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).filter("n = 1")
    if stops is not None:
        one = one.join(stops.select(F.col("node").alias("b")), "b", "left_anti")
    jump = cut_lineage(one.select(F.col("b").alias("node"), F.col("a").alias("head"), F.lit(1).cast("long").alias("dist"),
                                  F.lit(True).alias("open")))
    total, reached = jump.count(), 1
    while True:
        n = Observation()
        on = jump.select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("dist").alias("more"), F.col("open").alias("still"))
        moved = jump.filter("open").join(on, "head", "left").select(
            "node", F.coalesce("further", "head").alias("head"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
            F.coalesce("still", F.lit(False)).alias("open"))
        jump = cut_lineage(moved.unionByName(jump.filter("NOT open")).observe(n, F.count_if("open").alias("open")))
        reached *= 2
        if not n.get["open"] or reached > total:
            break
    # after that many steps a pointer that is still open goes round a ring
    return jump.select("node", F.when(~F.col("open"), F.col("head")).alias("head"), F.when(~F.col("open"), F.col("dist")).alias("dist"))


def _contracted(edges: DataFrame, jumps: DataFrame) -> DataFrame:
    """(a, b, w): edges into the nodes that ``jumps`` does not hold, from the heads of their parents."""
    into = edges.join(jumps.select(F.col("node").alias("b")), "b", "left_anti")
    via = into.join(jumps.select(F.col("node").alias("a"), F.col("head"), "dist", F.lit(True).alias("inner")), "a", "left")
    return via.filter("inner IS NULL OR head IS NOT NULL").select(
        F.coalesce("head", "a").alias("a"), "b", (F.coalesce("dist", F.lit(0)) + 1).alias("w"))


def reach(edges: DataFrame, start: str, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
    """L2: nodes reachable from ``start`` with their shortest depth; the start is not reported.

    With ``max_depth`` one hop per round.  Without it, nodes with one parent are reached by pointer jumping (``heads``), and
    only hops between the others are walked, so a deep chain or tree takes rounds by the logarithm of its depth.
    """
    e = _oriented(edges, direction)
    if max_depth is not None:
        me = edges.sparkSession.range(1).select(F.lit(start).alias("name"))
        seen = walk(e.select(F.col("a").alias("a_name"), F.col("b").alias("b_name")), me, max_depth)
    else:
        seen = _reach_by_jumps(cut_lineage(e.distinct()), start)
    return seen.filter("depth > 0").select("name", F.col("depth").cast("int").alias("depth"), F.lit(direction).alias("direction"))


def _reach_by_jumps(e: DataFrame, start: str) -> DataFrame:
    me = e.sparkSession.range(1).select(F.lit(start).alias("node"))
    jumps = heads(e, me)
    short = cut_lineage(_contracted(e, jumps).groupBy("a", "b").agg(F.min("w").alias("w")))
    best = cut_lineage(me.withColumn("depth", F.lit(0).cast("long")))
    frontier = best
    while True:
        n = Observation()
        step = frontier.join(short, frontier["node"] == short["a"]).groupBy(F.col("b").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("new"))
        better = step.join(best, "node", "left").filter("depth IS NULL OR new < depth").select("node", F.col("new").alias("depth"))
        better = cut_lineage(better.observe(n, F.count(F.lit(1)).alias("n")))
        if not n.get["n"]:
            break
        best = cut_lineage(best.join(better, "node", "left_anti").unionByName(better))
        frontier = better
    inner = jumps.join(best.withColumnRenamed("node", "head"), "head").select("node", (F.col("depth") + F.col("dist")).alias("depth"))
    return best.unionByName(inner).withColumnRenamed("node", "name")


def impact(column_edges: DataFrame, dataset: str, column: str | None = None, max_depth: int | None = None) -> DataFrame:
    """L3: downstream impact of a dataset (or one of its columns) over column-level edges
    ``(src_dataset, src_column) -> (dst_dataset, dst_column)``, optionally with the ``job`` that
    writes them: per reached dataset its columns, least depth and distinct jobs.  Datasets and
    columns stay apart, so names may hold dots."""
    jobs = column_edges if "job" in column_edges.columns else column_edges.withColumn("job", F.lit(None).cast("string"))
    e = column_edges.select(F.col("src_dataset").alias("a_dataset"), F.col("src_column").alias("a_column"),
                            F.col("dst_dataset").alias("b_dataset"), F.col("dst_column").alias("b_column"))
    starts = column_edges.filter(F.col("src_dataset") == dataset).select(
        F.col("src_dataset").alias("dataset"), F.col("src_column").alias("column"))
    if column is not None:
        starts = starts.filter(F.col("column") == column)
    seen = walk(e, starts, max_depth)
    r = seen.filter("depth > 0")
    cols = r.groupBy("dataset").agg(F.count(F.lit(1)).alias("columns"), F.min("depth").alias("min_depth"),
                                    F.sort_array(F.collect_set("column")).alias("column_names"))
    # jobs that write a reached column from a column of the walk
    by = (jobs.join(seen.select(F.col("dataset").alias("src_dataset"), F.col("column").alias("src_column")),
                    ["src_dataset", "src_column"], "left_semi")
          .join(r.select(F.col("dataset").alias("dst_dataset"), F.col("column").alias("dst_column")),
                ["dst_dataset", "dst_column"], "left_semi")
          .groupBy(F.col("dst_dataset").alias("dataset")).agg(F.count_distinct("job").alias("jobs")))
    return cols.join(by, "dataset", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))


def task_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """L4: longest-path level of each task (Kahn order, iteratively in Spark).

    Tasks with one parent take their head's level and their distance from it (``heads``, in rounds by the
    logarithm of the depth).  For the others, a round settles those whose parents are all settled; only the edges
    that leave the last round's tasks are joined, and each open task keeps the number of its parents
    still missing.  It ends when a round settles nothing.  Tasks left in a cycle get one more than their
    highest settled parent, or 0 when none is settled.
    """
    whole = cut_lineage(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    ends = whole.select(F.col("a").alias("task")).union(whole.select(F.col("b").alias("task"))).distinct()
    nodes = ends if nodes is None else nodes
    # a task that is not asked for is never settled, so nothing jumps over it
    jumps = heads(whole, ends.join(nodes, "task", "left_anti").withColumnRenamed("task", "node"))
    loose = whole.join(jumps.select(F.col("node").alias("b")), "b", "left_anti")
    held = loose.join(jumps.select(F.col("node").alias("a"), "head", "dist"), "a", "left")
    # a parent on a ring without a head is never settled: the edge counts as missing and is never joined
    e = cut_lineage(held.select(F.coalesce("head", "a").alias("src"), F.col("b").alias("dst"), (F.coalesce("dist", F.lit(0)) + 1).alias("w")))
    inner = jumps.join(nodes.select(F.col("task").alias("node")), "node", "left_semi")
    nodes = nodes.join(jumps.select(F.col("node").alias("task")), "task", "left_anti")
    indeg = e.groupBy(F.col("dst").alias("task")).agg(F.count(F.lit(1)).alias("missing"))
    start = nodes.join(indeg, "task", "left").select("task", F.coalesce("missing", F.lit(0)).alias("missing"), F.lit(0).cast("long").alias("level"))
    open_ = cut_lineage(start)
    settled, k = None, 0
    while True:
        ready = open_.filter("missing = 0").select("task", "level")
        settled = ready if settled is None else settled.unionByName(ready)
        hit = (ready.join(e, ready["task"] == e["src"]).groupBy(F.col("dst").alias("task"))
               .agg(F.count(F.lit(1)).alias("less"), F.max(F.col("level") + F.col("w")).alias("up")))
        n = Observation()
        rest = open_.filter("missing > 0").join(hit, "task", "left").select(
            "task", (F.col("missing") - F.coalesce("less", F.lit(0))).alias("missing"),
            F.greatest("level", F.coalesce("up", F.lit(0).cast("long"))).alias("level"))
        open_ = cut_lineage(rest.observe(n, F.count_if(F.col("missing") == 0).alias("ready")))
        k += 1
        if k % 4 == 0:
            settled = cut_lineage(settled)
        if not n.get["ready"]:
            break
    settled = cut_lineage(settled.withColumn("done", F.lit(True)))
    known = settled.unionByName(open_.select("task", "level", F.lit(False).alias("done")))
    up = settled.filter("done").select(F.col("task").alias("head"), "level")
    below = inner.join(up, "head", "left").select(F.col("node").alias("task"), F.coalesce(F.col("level") + F.col("dist"), F.lit(0)).alias("level"))
    return known.select("task", "level").unionByName(below).withColumn("level", F.col("level").cast("int"))


def declare_inputs(edges: DataFrame, inputs: DataFrame, job_output: str | None = None) -> DataFrame:
    """Add declared external inputs as edges (``inputs`` has ``src`` and, unless
    ``job_output`` is given, ``dst``); lower-cased, de-duplicated."""
    extra = inputs.select(F.lower("src").alias("src"),
                          (F.lit(job_output) if job_output is not None else F.lower("dst")).alias("dst"))
    return edges.select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).unionByName(extra).distinct()
