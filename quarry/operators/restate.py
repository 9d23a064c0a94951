"""Restatement and tracking."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _d(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(str(x)[:10]).cast("date")


def calendar(spark: SparkSession, start, end, step: str = "1 day") -> DataFrame:
    """Dates from start to end inclusive (bounded by the span, one row per slot)."""
    return spark.range(1).select(F.explode(F.sequence(_d(start), _d(end), F.expr(f"INTERVAL {step}"))).alias("slot"))


STEP_UNITS = ("hour", "day", "week", "month", "quarter", "year")


def missing_slots(df: DataFrame, column: str, start, end, step: str = "1 day") -> DataFrame:
    """Expected slots minus the slots present in ``df`` (left anti join).

    ``step`` is ``1 <unit>``; times are truncated to the unit.  With hourly steps the calendar
    covers every hour of the last day.  The present side is a partially aggregated distinct.
    """
    n, unit = step.split()
    unit = unit.rstrip("s")
    if int(n) != 1 or unit not in STEP_UNITS:
        raise ValueError(f"step is one of {STEP_UNITS}, once")
    if unit == "day":
        slot, cal = F.to_date(column), calendar(df.sparkSession, start, end, step)
    else:
        slot = F.date_trunc(unit, F.col(column).cast("timestamp_ntz")).cast("timestamp_ntz")
        last = F.date_add(_d(end), 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 SECOND")
        cal = df.sparkSession.range(1).select(F.explode(F.sequence(
            F.date_trunc(unit, _d(start).cast("timestamp_ntz")).cast("timestamp_ntz"), last, F.expr(f"INTERVAL {step}"))).alias("slot"))
    present = df.select(slot.alias("slot")).distinct()
    return cal.join(present, "slot", "left_anti")


def missing_dates(df: DataFrame, column: str, start, end) -> DataFrame:
    """J5 with daily slots."""
    return missing_slots(df, column, start, end)


def expand_slots(spark: SparkSession, from_date, to_date, max_days: int = 90) -> DataFrame:
    """B1: a date range to daily slots; ``from <= to`` and at most ``max_days`` days.

    Literal dates are checked on the driver; Column endpoints (derived from data) are
    checked per row with ``raise_error``.
    """
    if not isinstance(from_date, Column) and not isinstance(to_date, Column):
        a, b = date.fromisoformat(str(from_date)[:10]), date.fromisoformat(str(to_date)[:10])
        if a > b:
            raise ValueError("from_date must not be after to_date")
        if (b - a).days + 1 > max_days:
            raise ValueError(f"a restatement covers at most {max_days} days")
        base = spark.range(1).select(_d(a).alias("f"), _d(b).alias("t"))
    else:
        base = spark.range(1).select(_d(from_date).alias("f"), _d(to_date).alias("t"))
    return _expand(base, max_days)


def expand_slots_of(bounds: DataFrame, max_days: int = 90) -> DataFrame:
    """B1 for ranges held in a DataFrame (columns ``f``, ``t``), checked row by row."""
    return _expand(bounds, max_days)


def _expand(base: DataFrame, max_days: int) -> DataFrame:
    span = F.datediff("t", "f") + 1
    # the check feeds the sequence itself, so it cannot be pruned away
    last = F.when(F.col("f") > F.col("t"), F.raise_error(F.lit("from_date after to_date")).cast("date")) \
        .when(span > max_days, F.raise_error(F.lit(f"range longer than {max_days} days")).cast("date")).otherwise(F.col("t"))
    keep = [c for c in base.columns if c not in ("f", "t")]
    return base.select(*keep, F.explode(F.sequence("f", last)).alias("slot")).select(
        "*", F.date_format(F.col("slot").cast("timestamp_ntz"), "dd_MM_yyyy_HH").alias("date_key"))


def latest_status(tracker: DataFrame, keys) -> DataFrame:
    """The newest marker of each slot of an append-only tracker (``completed_at``, when there)."""
    from .windows import latest_per

    keys = list(keys)
    return latest_per(tracker, keys, ["completed_at"]) if "completed_at" in tracker.columns else tracker


def pending_slots(slots: DataFrame, tracker: DataFrame, restate: bool = False, keys=("dataset", "slot")) -> DataFrame:
    """Slots that still need a run: those whose newest marker is no success, or all when
    restating."""
    if restate:
        return slots
    done = latest_status(tracker, keys).filter(F.col("status") == "success").select(*keys)
    return slots.join(done, list(keys), "left_anti")


CLEARED = "cleared"


def restate(tracker: DataFrame, slots: DataFrame, keys=("dataset", "slot")) -> DataFrame:
    """B2: tracker with the markers of the given slots cleared (those slots will re-run)."""
    return tracker.join(slots.select(*keys).distinct(), list(keys), "left_anti")


def clear_markers(spark: SparkSession, tracker_path: str, slots: DataFrame, keys=("table", "partition")) -> int:
    """B2 on a stored tracker: appends a ``cleared`` marker for each given slot that has one, so
    a restatement that dies half-way does not look done.  Returns how many were cleared."""
    from ..sinks import writers as W

    t = latest_status(W.read_tracker(spark, tracker_path), keys)
    hit = t.filter(F.col("status") != CLEARED).join(slots.select(*keys).distinct(), list(keys), "left_semi")
    hit = hit.withColumn("status", F.lit(CLEARED)).withColumn("rows_written", F.lit(0).cast("long")) \
        .withColumn("completed_at", F.current_timestamp())
    from ..session import cut_lineage

    rows = cut_lineage(hit)
    n = rows.count()
    if n:
        W.append(rows, tracker_path)
    return n


def restatement_history(registry: DataFrame, dataset: str | None, days: int, as_of) -> DataFrame:
    """Restatements of the last ``days`` days (one dataset or all) with the row delta.

    A registry kept by ``record_restatement`` has a row per change of state (``recorded_at``); the
    newest of each restatement counts."""
    if "recorded_at" in registry.columns:
        registry = current_restatements(registry)
    a = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    r = registry.filter(F.col("triggered_at") >= a - F.expr(f"INTERVAL {int(days)} DAYS"))
    if dataset is not None:
        r = r.filter(F.col("dataset_id") == dataset)
    return r.withColumn("row_delta", F.col("rows_after") - F.col("rows_before"))


# Columns and states of the restatement registry.
REGISTRY_SCHEMA = (
    "restatement_id string, dataset_id string, pipeline_id string, triggered_by string, triggered_at timestamp, "
    "date_range_start date, date_range_end date, layers array<string>, reason string, status string, trackers_deleted int, "
    "partitions_affected int, dag_run_ids array<string>, rows_before long, rows_after long, completed_at timestamp, "
    "error_message string, recorded_at timestamp")
PENDING, IN_PROGRESS, COMPLETED, FAILED, CANCELLED = "PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "CANCELLED"
REGISTRY_MONTH = "_month"


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    """Every record of the registry, one per change of state."""
    from ..sinks import tables, writers as W

    if not W.path_exists(spark, registry_path):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return tables.read_stored(spark, registry_path, [REGISTRY_MONTH]).drop(REGISTRY_MONTH)


def current_restatements(registry: DataFrame) -> DataFrame:
    """The newest record of each restatement."""
    from .windows import latest_per

    return latest_per(registry, ["restatement_id"], ["recorded_at"]).drop("recorded_at")


def record_restatement(spark: SparkSession, registry_path: str, record: dict) -> None:
    """Appends one record, stamped with Spark's clock, to the registry of its month."""
    from ..sinks import writers as W

    names = [f.split()[0] for f in REGISTRY_SCHEMA.split(", ")]
    unknown = set(record) - set(names)
    if unknown:
        raise ValueError(f"not columns of the registry: {sorted(unknown)}")
    now = F.current_timestamp()
    row = spark.createDataFrame([tuple(record.get(c) for c in names)], REGISTRY_SCHEMA).withColumn("recorded_at", now)
    row = row.withColumn("triggered_at", F.coalesce("triggered_at", now))
    if record["status"] in (COMPLETED, FAILED, CANCELLED):
        row = row.withColumn("completed_at", F.coalesce("completed_at", now))
    W.append(row.withColumn(REGISTRY_MONTH, F.date_format("triggered_at", "yyyy_MM")), registry_path, [REGISTRY_MONTH])


def restate_slots(spark: SparkSession, path: str, corrected: DataFrame, partition_cols, registry_path: str, dataset: str,
                  pipeline: str, triggered_by: str, reason: str, start, end, layers=(), tracker_path: str | None = None,
                  slots: DataFrame | None = None, restatement_id: str | None = None, dag_run_ids=()) -> dict:
    """Restates the slots that ``corrected`` holds and keeps the registry's record of it.

    Record PENDING; clear the markers of ``slots`` (``table``, ``partition``); record IN_PROGRESS; count the
    rows of those slots as they stand (only they are read); overwrite them, the new rows observed on the
    write itself; record COMPLETED with both counts, or FAILED with the error, which is raised again.  Slots
    without corrected rows stay as they are (K5).  Returns the last record.
    """
    from uuid import uuid4

    from ..session import cut_lineage
    from ..sinks import tables, writers as W

    if not reason:
        raise ValueError("a restatement needs a reason")
    day = lambda x: x if isinstance(x, date) and not isinstance(x, datetime) else date.fromisoformat(str(x)[:10])
    parts = list(partition_cols)
    record = {"restatement_id": restatement_id or f"rst-{uuid4()}", "dataset_id": dataset, "pipeline_id": pipeline,
              "triggered_by": triggered_by, "date_range_start": day(start), "date_range_end": day(end), "layers": list(layers),
              "reason": reason, "status": PENDING, "dag_run_ids": list(dag_run_ids),
              "triggered_at": spark.sql("SELECT current_timestamp()").first()[0]}
    record_restatement(spark, registry_path, record)
    try:
        if tracker_path and slots is not None:
            record["trackers_deleted"] = clear_markers(spark, tracker_path, slots)
        record["status"] = IN_PROGRESS
        record_restatement(spark, registry_path, record)
        rows = cut_lineage(corrected)
        touched = cut_lineage(rows.select(*parts).distinct())
        record["partitions_affected"] = touched.count()
        held = W.path_exists(spark, path)
        record["rows_before"] = tables.keep_where(tables.read_stored(spark, path, parts), touched, parts).count() if held else 0
        record["rows_after"] = W.write_guarded(rows, path, parts)
        record["status"] = COMPLETED
    except Exception as error:
        record |= {"status": FAILED, "error_message": str(error)[:2000]}
        record_restatement(spark, registry_path, record)
        raise
    record_restatement(spark, registry_path, record)
    return record


ACTIVE_STATES = ("pending", "running", "PENDING", "IN_PROGRESS")


def conflicts(registry: DataFrame, requests: DataFrame, bucket_days: int = 31) -> DataFrame:
    """Every requested restatement with whether it overlaps an active one of its dataset."""
    from .joins import overlapping

    active = registry.filter(F.col("status").isin(*ACTIVE_STATES)).select("dataset_id", "date_range_start", "date_range_end")
    req = requests.select("dataset_id", F.col("restatement_id").alias("request_id"), "date_range_start", "date_range_end")
    return overlapping(req, active, "dataset_id", "date_range_start", "date_range_end", bucket_days)


def cascade(edges: DataFrame, dataset: str, depth: str = "all") -> DataFrame:
    """Datasets to restate and their phase (parents first).

    ``self`` -> the dataset alone; ``children`` -> plus direct downstream; ``all`` -> every
    downstream dataset, however far.  The phase is the longest path from the dataset inside the
    chosen set, so every parent runs in an earlier phase (tasks of a cycle: see ``task_levels``).
    """
    from .lineage import reach, task_levels

    me = edges.sparkSession.range(1).select(F.lit(dataset).alias("name"))
    if depth == "self":
        return me.withColumn("phase", F.lit(0))
    down = reach(edges, dataset, "downstream", 1 if depth == "children" else None)
    if depth == "children":
        return me.withColumn("phase", F.lit(0)).unionByName(down.select("name", F.col("depth").alias("phase")))
    chosen = me.unionByName(down.select("name"))
    # edges back into the start would make it wait for its own descendants
    inner = (edges.filter(F.col("dst") != dataset)
             .join(chosen.withColumnRenamed("name", "src"), "src", "left_semi")
             .join(chosen.withColumnRenamed("name", "dst"), "dst", "left_semi"))
    levels = task_levels(inner, chosen.withColumnRenamed("name", "task"))
    return levels.select(F.col("task").alias("name"), F.col("level").alias("phase"))


#: a slot whose data was written but whose quality gate failed
DQ_FAILED = "DQ_FAILED"


def restatement_progress(slots: DataFrame, tracker: DataFrame, keys=("layer", "slot")) -> DataFrame:
    """Per layer, slots done / failed / failed on quality / pending and an overall status,
    from each slot's newest marker."""
    t = latest_status(tracker, keys).select(*keys, "status")
    j = slots.select(*keys).distinct().join(t, list(keys), "left")
    status = F.col("status")
    g = j.groupBy(keys[0]).agg(
        F.count(F.lit(1)).alias("slots"),
        F.count_if(status == "success").alias("done"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == DQ_FAILED).alias("dq_failed"),
        F.count_if(status.isNull() | (status == CLEARED)).alias("pending"))
    return g.withColumn("state", F.when(F.col("failed") + F.col("dq_failed") > 0, "partial_failure")
                        .when(F.col("done") == F.col("slots"), "completed").otherwise("running"))
