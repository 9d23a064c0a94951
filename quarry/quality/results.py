"""Fixed schemas of the three quality tables and helpers to build result rows as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statuses and severities of the quality data model.
PASS, FAIL, WARN, SKIPPED = "PASS", "FAIL", "WARN", "SKIPPED"
SEVERITIES = ("critical", "warning", "info")

# Fixed value: check families a rule type belongs to (schema / content / volume / freshness).
FAMILY_OF_TYPE = {
    "schema": "schema",
    "not_null": "content",
    "value_range": "content",
    "accepted_values": "content",
    "unique_key": "content",
    "uniqueness": "content",
    "regex": "content",
    "expression": "content",
    "null_rate": "content",
    "references": "content",
    "custom_sql": "content",
    "row_count": "volume",
    "row_count_delta": "volume",
    "row_count_change": "volume",
    "slots_complete": "volume",
    "max_staleness_hours": "freshness",
    "not_future": "freshness",
}

AUTO_METRICS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("pipeline_name", T.StringType(), True),
    T.StructField("dataset_path", T.StringType(), False),
    T.StructField("environment", T.StringType(), True),
    T.StructField("run_timestamp", T.TimestampType(), False),
    T.StructField("rows_written", T.LongType(), False),
    T.StructField("schema_json", T.StringType(), True),
    T.StructField("column_profiles", T.StringType(), True),
    T.StructField("write_duration_ms", T.LongType(), True),
])

RULE_RESULT_FIELDS = T.StructType([
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("rule_type", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("message", T.StringType(), True),
    T.StructField("actual_value", T.StringType(), True),
    T.StructField("expected_value", T.StringType(), True),
    T.StructField("affected_rows", T.LongType(), True),
    T.StructField("check_family", T.StringType(), True),
])

RULE_RESULTS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("pipeline_name", T.StringType(), True),
        T.StructField("dataset_path", T.StringType(), False),
        T.StructField("run_timestamp", T.TimestampType(), False),
    ]
    + RULE_RESULT_FIELDS.fields
)

ANOMALY_RESULTS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("dataset_path", T.StringType(), False),
    T.StructField("run_timestamp", T.TimestampType(), False),
    T.StructField("metric_name", T.StringType(), False),
    T.StructField("current_value", T.DoubleType(), True),
    T.StructField("mean_30d", T.DoubleType(), True),
    T.StructField("stddev_30d", T.DoubleType(), True),
    T.StructField("z_score", T.DoubleType(), True),
    T.StructField("is_anomaly", T.BooleanType(), False),
    T.StructField("severity", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
])

RESULT_COLUMNS = [f.name for f in RULE_RESULT_FIELDS.fields]


def _s(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def result_struct(
    name: str,
    rule_type: str,
    severity: str,
    status,
    message,
    actual=None,
    expected=None,
    affected=0,
) -> Column:
    """One rule-result row as a struct Column (all fields typed as in the schema)."""
    return F.struct(
        F.lit(name).cast("string").alias("rule_name"),
        F.lit(rule_type).cast("string").alias("rule_type"),
        F.lit(severity).cast("string").alias("severity"),
        _s(status).cast("string").alias("status"),
        _s(message).cast("string").alias("message"),
        _s(actual).cast("string").alias("actual_value"),
        _s(expected).cast("string").alias("expected_value"),
        _s(affected).cast("long").alias("affected_rows"),
        F.lit(FAMILY_OF_TYPE.get(rule_type, "content")).alias("check_family"),
    )


def check_family(rule_type: Column) -> Column:
    """Family of a rule type as a Column expression."""
    mapping = F.create_map(*[F.lit(x) for kv in FAMILY_OF_TYPE.items() for x in kv])
    return F.coalesce(mapping[rule_type], F.lit("content"))
