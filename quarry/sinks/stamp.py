"""K3/K4: partition stamps of the layered tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DATE_KEY_COLUMN, DATE_KEY_FORMAT, date_key


def _slot_dt(slot) -> datetime:
    if isinstance(slot, datetime):
        return slot
    return datetime.fromisoformat(str(slot))


def stamp_bronze(df: DataFrame, slot, time_col: str | None = None, has_hour: bool = False) -> DataFrame:
    """K3: ``__year/__month/__day`` from the run slot, ``__hour`` from the row time when
    ``has_hour`` (else the slot hour), all integers."""
    s = _slot_dt(slot)
    hour = F.hour(F.col(time_col)) if (has_hour and time_col) else F.lit(s.hour)
    return df.select("*", F.lit(s.year).alias("__year"), F.lit(s.month).alias("__month"),
                     F.lit(s.day).alias("__day"), hour.cast("int").alias("__hour"))


def stamp_bronze_from_rows(df: DataFrame, time_col: str) -> DataFrame:
    """K3, row form: every row stamped from its own time column (multi-slot loads)."""
    t = F.col(time_col)
    return df.select("*", F.year(t).alias("__year"), F.month(t).alias("__month"),
                     F.dayofmonth(t).alias("__day"), F.hour(t).alias("__hour"))


def stamp_datekey(df: DataFrame, slot=None, time_col: str | None = None) -> DataFrame:
    """K4: one string ``__date = DD_MM_YYYY_HH`` from the slot, or from each row's time."""
    if time_col is not None:
        return df.withColumn(DATE_KEY_COLUMN, date_key(time_col))
    return df.withColumn(DATE_KEY_COLUMN, F.lit(_slot_dt(slot).strftime("%d_%m_%Y_%H")))


__all__ = ["stamp_bronze", "stamp_bronze_from_rows", "stamp_datekey", "DATE_KEY_FORMAT"]
