"""Scalar helpers as Column expressions: all JVM-side, inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Partition-key formats of the data model.
DATE_KEY_FORMAT = "dd_MM_yyyy_HH"
BRONZE_KEYS = ("__year", "__month", "__day", "__hour")
DATE_KEY_COLUMN = "__date"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def date_key(ts) -> Column:
    """``DD_MM_YYYY_HH`` slot key of a timestamp."""
    return F.date_format(_c(ts), DATE_KEY_FORMAT)


def parse_date_key(key) -> Column:
    """Inverse of ``date_key``: the slot start as a timestamp."""
    return F.to_timestamp_ntz(_c(key), F.lit(DATE_KEY_FORMAT))


def table_slug(name) -> Column:
    """Keep only a-z and 0-9 of the lower-cased name (table names of generated jobs)."""
    return F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]", "")


def safe_dataset_name(path) -> Column:
    """``silver/orders_clean`` -> ``silver_orders_clean`` (strip slashes, then replace)."""
    return F.regexp_replace(F.regexp_replace(_c(path), "^/+|/+$", ""), "/", "_")


def container_of(path) -> Column:
    """First path segment: the layer / container of a dataset path."""
    return F.element_at(F.split(F.regexp_replace(_c(path), "^/+|/+$", ""), "/"), 1)


def dataset_from_table(table, suffix: str) -> Column:
    """``silver_orders_rules`` -> ``silver/orders``: strip the suffix, first ``_`` becomes ``/``."""
    base = F.regexp_replace(_c(table), f"{re.escape(suffix)}$", "")
    return F.regexp_replace(base, "^([^_]*)_", "$1/")


def tag_value(tag, prefix: str) -> Column:
    """``source:Foo`` -> ``foo`` when the tag has the prefix, else NULL."""
    t = _c(tag)
    return F.when(t.startswith(f"{prefix}:"), F.lower(F.regexp_replace(t, F.lit(f"^{re.escape(prefix)}:"), F.lit(""))))


def run_date_from_id(run_id) -> Column:
    """Timestamp embedded in a run id like ``scheduled__2024-01-02T03:00:00``."""
    s = F.regexp_extract(_c(run_id), r"__(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1)
    return F.to_timestamp(F.nullif(s, F.lit("")), "yyyy-MM-dd'T'HH:mm:ss")


def run_kind(run_id, run_type=None) -> Column:
    """Backfill / Manual / Scheduled from the run id prefix (and run type)."""
    r = _c(run_id)
    manual = r.startswith("manual__")
    if run_type is not None:
        manual = manual | (_c(run_type) == "manual")
    return F.when(r.startswith("backfill__"), "Backfill").when(manual, "Manual").otherwise("Scheduled")


def layer_label(layer) -> Column:
    """``silver`` -> ``Silver Delta Table`` style label."""
    return F.concat(F.initcap(_c(layer)), F.lit(" Delta Table"))


def human_count(n) -> Column:
    """1.2K / 3.4M / 5.6B for large counts, plain digits below 1000."""
    x = _c(n).cast("double")
    return (F.when(x.isNull(), F.lit("—"))
            .when(x >= 1e9, F.concat(F.format_number(x / 1e9, 1), F.lit("B")))
            .when(x >= 1e6, F.concat(F.format_number(x / 1e6, 1), F.lit("M")))
            .when(x >= 1e3, F.concat(F.format_number(x / 1e3, 1), F.lit("K")))
            .otherwise(F.format_number(x, 0)))


def human_bytes(n) -> Column:
    """KB / MB / GB with one decimal; zero or NULL shows a dash."""
    x = _c(n).cast("double")
    return (F.when(x.isNull() | (x == 0), F.lit("—"))
            .when(x >= 1073741824, F.concat(F.format_number(x / 1073741824, 1), F.lit(" GB")))
            .when(x >= 1048576, F.concat(F.format_number(x / 1048576, 1), F.lit(" MB")))
            .otherwise(F.concat(F.format_number(x / 1024, 1), F.lit(" KB"))))


def pct(part, whole, digits: int = 2) -> Column:
    """``round(part / whole * 100, digits)`` with a NULLIF guard on the divisor."""
    return F.round(_c(part) * 100.0 / F.nullif(_c(whole), F.lit(0)), digits)


def log_field(line, field: str) -> Column:
    """FN7: the value of ``field=value`` or ``"field": "value"`` in a log line, else NULL."""
    got = F.regexp_extract(_c(line), rf"""\b{re.escape(field)}"?\s*[=:]\s*"?([^\s",;}}]+)""", 1)
    return F.nullif(got, F.lit(""))


def month_start(ts) -> Column:
    """FN12: the time truncated to its month."""
    return F.date_trunc("month", _c(ts))


def clean_string(c) -> Column:
    """``lower(trim(c))``."""
    return F.lower(F.trim(_c(c)))
