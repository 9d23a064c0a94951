"""one partition slot of a layered job, end to end.

read -> user logic -> stamp -> guarded dynamic overwrite (row count observed on the write)
-> register the slot -> quality gate, when given -> tracker marker last.  A slot whose newest
marker is a success is skipped unless ``restate``; restating first supersedes the old marker, so
a run that dies half-way leaves the slot pending; the overwrite replaces the slot and the new
marker is appended.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.restate import DQ_FAILED, clear_markers
from ..sinks import writers as W
from ..sinks.stamp import stamp_bronze, stamp_datekey
from ..sources.readers import read_slot


@dataclass
class SlotSink:
    path: str
    layer: str                      # bronze stamps year/month/day/hour, others the date key
    table: str
    tracker_path: str
    database: str | None = None
    time_col: str | None = None
    has_hour: bool = False


def slot_key(slot: datetime) -> str:
    return slot.strftime("%d_%m_%Y_%H")


def is_done(spark: SparkSession, sink: SlotSink, slot: datetime) -> bool:
    mine = W.read_tracker(spark, sink.tracker_path).filter(
        (F.col("table") == sink.table) & (F.col("partition") == slot_key(slot)))
    return not W.latest_marks(mine).filter(F.col("status") == "success").isEmpty()


def run_slot(spark: SparkSession, source: Callable[[SparkSession, datetime], DataFrame],
             transform: Callable[[DataFrame], DataFrame], sink: SlotSink, slot: datetime,
             restate: bool = False, job: str = "job", quality: Callable[[DataFrame], dict] | None = None) -> dict:
    """``quality`` gets the written slot and raises ``QualityGateError`` when it must not pass;
    the slot is then marked ``DQ_FAILED`` and the error goes on."""
    from ..quality.gate import QualityGateError

    key = slot_key(slot)
    if not restate and is_done(spark, sink, slot):
        return {"status": "skipped", "rows": 0, "slot": key}
    if restate:
        mine = spark.createDataFrame([(sink.table, key)], "table string, partition string")
        clear_markers(spark, sink.tracker_path, mine)
    df = source(spark, slot).transform(transform)
    if sink.layer == "bronze":
        df = stamp_bronze(df, slot, sink.time_col, sink.has_hour)
        parts = ["__year", "__month", "__day", "__hour"]
    else:
        df = stamp_datekey(df, slot)
        parts = ["__date"]
    rows = W.write_guarded(df, sink.path, parts)
    if rows == 0:
        return {"status": "empty", "rows": 0, "slot": key}
    written = read_slot(spark.read.parquet(sink.path), sink.layer, slot)
    if sink.database:
        W.register(spark, sink.database, sink.table, sink.path, partitioned=True, slots=written.select(*parts))
    if quality is not None:
        try:
            quality(written)
        except QualityGateError:
            W.mark_done(spark, sink.tracker_path, job, sink.table, key, rows, status=DQ_FAILED)
            raise
    W.mark_done(spark, sink.tracker_path, job, sink.table, key, rows)
    return {"status": "success", "rows": rows, "slot": key}
