"""Joins (J1-J12).

Strategy notes: joins are declared and left to Catalyst/AQE (sort-merge by default, switched
to broadcast at runtime when a side is small in bytes).  No operator forces a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import layer_label


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def metric_trend(metrics: DataFrame, anomalies: DataFrame, metric: str = "rows_written",
                 limit: int | None = 30) -> DataFrame:
    """Metrics LEFT JOIN anomalies on run id and a constant metric name; newest ``limit``."""
    a = anomalies.filter(F.col("metric_name") == metric).select(
        F.col("run_id").alias("a_run_id"), F.col("dataset_path").alias("a_dataset"), "z_score", "is_anomaly",
        F.col("severity").alias("anomaly_severity"))
    m = metrics.filter(F.col("metric_name") == metric)
    j = m.join(a, (F.col("run_id") == F.col("a_run_id")) & (F.col("dataset_path") == F.col("a_dataset")), "left") \
        .drop("a_run_id", "a_dataset")
    if limit is not None:
        j = j.orderBy(F.col("run_timestamp").desc(), F.col("run_id").desc()).limit(limit)
    return j


def flag_has_dq(datasets: DataFrame, summaries: DataFrame, on: str = "dataset") -> DataFrame:
    """Every dataset with a ``has_dq`` flag (left join on distinct summary names)."""
    s = summaries.select(F.col(on).alias("__dq")).distinct()
    return datasets.join(s, datasets[on] == s["__dq"], "left").select(
        *[datasets[c] for c in datasets.columns], F.col("__dq").isNotNull().alias("has_dq"))


def live_tables(tables: DataFrame, columns: DataFrame, on=("schema", "name")) -> DataFrame:
    """Tables that appear in the live column catalogue (left semi join)."""
    return tables.join(columns.select(*_keys(on)), _keys(on), "left_semi")


def active_pipelines(pipelines: DataFrame, deployments: DataFrame, key: str = "dag_id") -> DataFrame:
    """Pipelines minus soft-deleted ones (left anti join on deleted deployments)."""
    deleted = deployments.filter(F.col("deleted_at").isNotNull()).select(key)
    return pipelines.join(deleted, key, "left_anti")


def upsert_join(target: DataFrame, source: DataFrame, keys) -> DataFrame:
    """J7/K11 join form: full outer join on keys; a key in the source takes all source values
    (update all), other target rows stay, new source keys are inserted.  A source key with
    different rows raises."""
    from ..sinks.merge import one_per_key

    keys = _keys(keys)
    s = one_per_key(source, keys).select(*[F.col(c).alias(f"s__{c}") for c in source.columns], F.lit(True).alias("__in_s"))
    t = target.select(*[F.col(c).alias(f"t__{c}") for c in target.columns])
    cond = None
    for k in keys:
        e = F.col(f"t__{k}").eqNullSafe(F.col(f"s__{k}"))
        cond = e if cond is None else cond & e
    j = t.join(s, cond, "full_outer")
    cols = []
    for c in target.columns:
        sc = F.col(f"s__{c}") if c in source.columns else F.lit(None)
        cols.append(F.when(F.col("__in_s"), sc).otherwise(F.col(f"t__{c}")).alias(c))
    return j.select(*cols)


def merged_ranges(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key, the disjoint unions of its closed day ranges that overlap or touch."""
    # points where a range starts (+1) or has ended (-1), one row per key and day
    s = ranges.select(key, F.to_date(start).alias("__d"), F.lit(1).alias("__v"))
    e = ranges.select(key, F.date_add(F.to_date(end), 1).alias("__d"), F.lit(-1).alias("__v"))
    days = s.unionByName(e).groupBy(key, "__d").agg(F.sum("__v").alias("__v"))
    w = Window.partitionBy(key).orderBy("__d")
    open_ = days.withColumn("__open", F.sum("__v").over(w)) \
        .withColumn("__was", F.coalesce(F.lag("__open").over(w), F.lit(0)))
    edges = open_.filter(((F.col("__was") == 0) & (F.col("__open") > 0)) | ((F.col("__open") == 0) & (F.col("__was") > 0)))
    out = edges.withColumn("__to", F.lead("__d").over(w)).filter("__open > 0")
    return out.select(key, F.col("__d").alias("busy_from"), F.date_sub("__to", 1).alias("busy_to"))


def overlapping(requests: DataFrame, active: DataFrame, key: str, start: str, end: str,
                bucket_days: int = 31, req_id: str = "request_id") -> DataFrame:
    """Every request with whether it overlaps an active range of its key.

    The active ranges of a key are first merged to disjoint ones, so the result has one row per
    request and the join cannot square: a request meets the merged ranges of the months it
    covers.  ``busy_from``/``busy_to`` is the first merged range it overlaps; ``n_ranges`` how many.
    Requests are matched by their values, so rows that share an id but not a range each get their own
    answer, and equal rows the same one.
    """
    def buckets(df, a, b):
        s = F.floor(F.unix_date(F.to_date(F.col(a))) / bucket_days)
        e = F.floor(F.unix_date(F.to_date(F.col(b))) / bucket_days)
        return df.withColumn("__b0", s).withColumn("__b", F.explode(F.sequence(s, e)))

    busy = buckets(merged_ranges(active, key, start, end), "busy_from", "busy_to") \
        .select(F.col(key).alias("__k"), "__b", F.col("__b0").alias("__a0"), "busy_from", "busy_to")
    r = buckets(requests.select(key, req_id, start, end).distinct(), start, end).select(
        F.col(key).alias("__rk"), F.col(req_id).alias("__rid"), F.col(start).alias("__rs"), F.col(end).alias("__re"),
        F.col("__b").alias("__rb"), F.col("__b0").alias("__r0"))
    hits = r.join(busy, (F.col("__rk") == F.col("__k")) & (F.col("__rb") == F.col("__b"))
                  & (F.to_date("__rs") <= F.col("busy_to")) & (F.to_date("__re") >= F.col("busy_from"))
                  & (F.col("__rb") == F.greatest("__r0", "__a0")))
    found = hits.groupBy("__rk", "__rid", "__rs", "__re").agg(F.count(F.lit(1)).alias("n_ranges"),
                                              F.min(F.struct("busy_from", "busy_to")).alias("__m"))
    mine = [F.col(a).eqNullSafe(F.col(b)) for a, b in ((key, "__rk"), (req_id, "__rid"), (start, "__rs"), (end, "__re"))]
    j = requests.join(found, mine, "left")
    return j.select(*[requests[c] for c in requests.columns], F.col("n_ranges").isNotNull().alias("conflict"),
                    F.coalesce("n_ranges", F.lit(0)).alias("n_ranges"),
                    F.col("__m.busy_from").alias("busy_from"), F.col("__m.busy_to").alias("busy_to"))


def resolve_nodes(nodes: DataFrame, catalogue: DataFrame, node: str = "name") -> DataFrame:
    """Lineage node -> catalogue entry (lower-case name match), else an external node.

    Fixed values: the node fields and their text forms."""
    cat = catalogue.select(F.lower("name").alias("__n"), F.col("name").alias("cat_name"), "schema", "layer")
    j = nodes.join(cat, F.lower(nodes[node]) == cat["__n"], "left")
    found = F.col("__n").isNotNull()
    return j.select(
        *[nodes[c] for c in nodes.columns],
        F.when(found, F.concat_ws("/", "schema", "cat_name")).otherwise(F.concat(F.lit("external:"), F.lower(nodes[node]))).alias("guid"),
        F.when(found, layer_label(F.col("layer"))).otherwise(F.lit("External")).alias("type"),
        F.when(found, F.concat_ws(".", F.lit("lakehouse"), "schema", "cat_name"))
        .otherwise(F.concat(F.lit("external:"), F.lower(nodes[node]))).alias("qualified_name"),
        F.coalesce(F.col("layer"), F.lit("external")).alias("layer"))


def serve_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Plain declarative join for serving queries (strategy left to Catalyst/AQE)."""
    return left.join(right, on, how)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a side that is expected to be small.

    The size decides at run time: AQE measures the small side's shuffled bytes and broadcasts it
    below ``spark.sql.autoBroadcastJoinThreshold``; otherwise it stays a shuffle join, with
    skewed partitions split.
    """
    return big.join(small, on, how)


def with_last_run(pipelines: DataFrame, runs: DataFrame, key: str = "dag_id", order: str = "start_date",
                  tie: str = "dag_run_id") -> DataFrame:
    """Newest run of each pipeline joined to the pipeline (one pass over runs).

    ``max_by`` aggregates partially on every task, so a pipeline with most of the runs still
    reduces to one row per task before the shuffle.
    """
    last = runs.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in runs.columns if c != key]), F.struct(order, tie)).alias("last"),
        F.count(F.lit(1)).alias("run_count"))
    last = last.select(key, "run_count", *[F.col(f"last.{c}").alias(f"last_{c}") for c in runs.columns if c != key])
    return pipelines.join(last, key, "left")
