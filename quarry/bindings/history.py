"""Bindings for history windows: events by day = one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..quality.history import (mean_last_runs, metrics_long, row_count_change, row_count_delta, run_delta,
                               slot_metrics, spc)
from ..quality.moments import day_moments, merge_days, spc_of_days
from ..session import scratch_path
from . import Registry

REG = Registry()


def event_metrics(t):
    e = t.events.withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return slot_metrics(e, F.to_date("ts").cast("timestamp_ntz"), ["event_type", "props"], "bronze/events")


METRICS_SQL = """
WITH e AS (SELECT ts, nullif(event_type, 'error') AS event_type, props FROM events),
g AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS run_timestamp, count(*) AS rows,
             coalesce(sum(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END), 0) AS n0,
             coalesce(sum(CASE WHEN props IS NULL THEN 1 ELSE 0 END), 0) AS n1
      FROM e GROUP BY 1),
m AS (
  SELECT 'bronze/events' AS dataset_path, strftime(run_timestamp, '%Y-%m-%dT%H:%M:%S') AS run_id, run_timestamp,
         'rows_written' AS metric_name, CAST(rows AS DOUBLE) AS value FROM g
  UNION ALL SELECT 'bronze/events', strftime(run_timestamp, '%Y-%m-%dT%H:%M:%S'), run_timestamp,
         'null_rate__event_type', round(n0 / rows, 6) FROM g
  UNION ALL SELECT 'bronze/events', strftime(run_timestamp, '%Y-%m-%dT%H:%M:%S'), run_timestamp,
         'null_rate__props', round(n1 / rows, 6) FROM g)
"""


@REG.query("w1_mean_last_runs", oracle=METRICS_SQL + """
SELECT dataset_path, run_id, metric_name, value,
       round(avg(value) OVER w, 6) AS hist_mean, count(value) OVER w AS hist_runs
FROM m WINDOW w AS (PARTITION BY dataset_path, metric_name ORDER BY run_timestamp, run_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
""")
def _w1(t):
    """Mean of the previous 7 runs per metric."""
    h = mean_last_runs(event_metrics(t), 7)
    return h.select("dataset_path", "run_id", "metric_name", "value", F.round("hist_mean", 6).alias("hist_mean"), "hist_runs")


@REG.query("r5_row_count_delta", oracle=METRICS_SQL + """,
h AS (SELECT run_id, value AS cur, avg(value) OVER w AS mean, count(value) OVER w AS runs
      FROM m WHERE metric_name = 'rows_written'
      WINDOW w AS (PARTITION BY dataset_path ORDER BY run_timestamp, run_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, (runs = 0 OR mean IS NULL OR mean = 0) AS no_base, greatest(0.0, (mean - cur) / mean * 100) AS drop FROM h)
SELECT run_id, CASE WHEN NOT no_base AND drop > 5.0 THEN 'FAIL' ELSE 'PASS' END AS status,
       CASE WHEN no_base THEN CAST(CAST(cur AS BIGINT) AS VARCHAR) ELSE printf('%.1f', drop) || '%' END AS actual_value,
       CASE WHEN no_base THEN NULL ELSE '<=5.0%' END AS expected_value,
       CAST(CASE WHEN NOT no_base AND drop > 5.0 THEN greatest(0, CAST(trunc(mean - cur) AS BIGINT)) ELSE 0 END AS BIGINT) AS affected_rows
FROM j
""")
def _r5(t):
    """Row-count drop against the mean of the previous 7 runs, every run."""
    r = row_count_delta(event_metrics(t), max_drop_pct=5.0, lookback_runs=7)
    return r.select("run_id", "status", "actual_value", "expected_value", "affected_rows")


@REG.query("w5_run_delta", oracle=METRICS_SQL + """
SELECT run_id, value AS rows_written, lag(value) OVER w AS prev_rows, value - lag(value) OVER w AS delta,
       round((value - lag(value) OVER w) * 100.0 / nullif(lag(value) OVER w, 0.0), 4) AS pct_change
FROM m WHERE metric_name = 'rows_written' WINDOW w AS (PARTITION BY dataset_path ORDER BY run_timestamp, run_id)
""")
def _w5(t):
    """Delta against the previous run (lag)."""
    return run_delta(event_metrics(t)).select("run_id", "rows_written", "prev_rows", "delta", "pct_change")


@REG.query("r24_row_count_change", oracle=METRICS_SQL + """,
d AS (SELECT run_id, value AS cur, lag(value) OVER (PARTITION BY dataset_path ORDER BY run_timestamp, run_id) AS prev
      FROM m WHERE metric_name = 'rows_written')
SELECT run_id,
       CASE WHEN prev IS NOT NULL AND prev <> 0 AND abs(cur - prev) * 100.0 / prev > 6.0 THEN 'FAIL' ELSE 'PASS' END AS status,
       CASE WHEN prev IS NULL OR prev = 0 THEN NULL ELSE printf('%.1f', abs(cur - prev) * 100.0 / prev) || '%' END AS actual_value,
       CAST(CASE WHEN prev IS NOT NULL AND prev <> 0 AND abs(cur - prev) * 100.0 / prev > 6.0 THEN abs(cur - prev) ELSE 0 END AS BIGINT) AS affected_rows
FROM d
""")
def _r24(t):
    """Two-sided change against the previous run, above 6% fails."""
    return row_count_change(event_metrics(t), 6.0).select("run_id", "status", "actual_value", "affected_rows")


SPC_SQL = """
, s AS (SELECT *, avg(value) OVER w AS mean_30d, stddev_pop(value) OVER w AS stddev_30d, count(value) OVER w AS points
        FROM (SELECT *, epoch_us(run_timestamp) AS t FROM mm)
        WINDOW w AS (PARTITION BY dataset_path, metric_name ORDER BY t RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (value - mean_30d) / stddev_30d AS z_score FROM s WHERE points >= 7 AND stddev_30d > 0)
SELECT run_id, metric_name, value AS current_value, round(mean_30d, 6) AS mean_30d, round(stddev_30d, 6) AS stddev_30d,
       round(z_score, 6) AS z_score, abs(z_score) > 3.0 AS is_anomaly,
       CASE WHEN NOT abs(z_score) > 3.0 THEN 'info' WHEN abs(z_score) > 4.5 THEN 'critical' ELSE 'warning' END AS severity
FROM z
"""


def _spc_out(df):
    return df.select("run_id", "metric_name", "current_value", F.round("mean_30d", 6).alias("mean_30d"),
                     F.round("stddev_30d", 6).alias("stddev_30d"), F.round("z_score", 6).alias("z_score"),
                     "is_anomaly", "severity")


@REG.query("w2_spc_anomalies", oracle=METRICS_SQL + ", mm AS (SELECT * FROM m)" + SPC_SQL)
def _w2(t):
    """30-day rolling mean / population stddev, z-score, 7-run minimum, zero stddev skipped."""
    return _spc_out(spc(event_metrics(t), days=30, z=3.0))


@REG.query("r19_anomalies_from_profiles", oracle=METRICS_SQL + """,
mm AS (SELECT * FROM m WHERE metric_name = 'rows_written' OR strftime(run_timestamp, '%d') <> '15')""" + SPC_SQL)
def _r19(t):
    """Stored auto metrics with JSON column profiles (one corrupt) -> long form -> SPC."""
    m = event_metrics(t)
    rows = m.filter(F.col("metric_name") == "rows_written")
    prof = (m.filter(F.col("metric_name") != "rows_written")
            .groupBy("dataset_path", "run_id", "run_timestamp")
            .agg(F.to_json(F.sort_array(F.collect_list(F.struct(
                F.regexp_replace("metric_name", "^null_rate__", "").alias("name"),
                F.col("value").alias("null_rate"))))).alias("column_profiles")))
    prof = prof.withColumn("column_profiles", F.when(F.date_format("run_timestamp", "dd") == "15", F.lit("{corrupt"))
                           .otherwise(F.col("column_profiles")))
    auto = rows.select("dataset_path", "run_id", "run_timestamp", F.col("value").cast("long").alias("rows_written")) \
        .join(prof, ["dataset_path", "run_id", "run_timestamp"], "left")
    return _spc_out(spc(metrics_long(auto), days=30, z=3.0))


HOURLY_SQL = """
WITH m AS (SELECT event_type AS metric_name, date_trunc('hour', ts) AS t, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL)
"""


def hourly_metrics(t):
    """One run an hour and event type: the value is its number of events."""
    at = F.date_trunc("hour", "ts").alias("run_timestamp")
    m = t.events.groupBy(at, F.col("event_type").alias("metric_name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return m.withColumns({"dataset_path": F.lit("bronze/events"), "run_id": F.date_format("run_timestamp", "yyyy-MM-dd'T'HH")})


@REG.query("w2_spc_from_days", oracle=HOURLY_SQL + """,
w AS (SELECT metric_name, t, value, avg(value) OVER x AS mean, stddev_pop(value) OVER x AS sd, count(value) OVER x AS points FROM m
      WINDOW x AS (PARTITION BY metric_name ORDER BY t RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
SELECT metric_name, t AS run_timestamp, value AS current_value, points, round(mean, 6) AS mean_30d, round(sd, 6) AS stddev_30d,
       round((value - mean) / sd, 5) AS z_score, abs((value - mean) / sd) > 3.0 AS is_anomaly
FROM w WHERE points >= 7 AND sd > 0 AND t >= (SELECT max(t) FROM m) - INTERVAL 72 HOUR
""")
def _w2d(t):
    """The newest 72 hourly runs scored against ten days kept as one row of moments per day."""
    path = scratch_path(t.spark, "w2d")
    m = hourly_metrics(t)
    day_moments(m).write.parquet(path)
    newest = m.agg(F.max("run_timestamp").alias("top"))
    new = m.join(newest, m.run_timestamp >= F.col("top") - F.expr("INTERVAL 72 HOURS")).drop("top")
    out = spc_of_days(new, t.spark.read.parquet(path), m, days=10)
    return out.select("metric_name", "run_timestamp", "current_value", "points", F.round("mean_30d", 6).alias("mean_30d"),
                      F.round("stddev_30d", 6).alias("stddev_30d"), F.round("z_score", 5).alias("z_score"), "is_anomaly")


@REG.query("r19_merged_days", oracle=HOURLY_SQL + """
SELECT metric_name, date_trunc('week', t) AS week, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM m GROUP BY ALL
""")
def _r19m(t):
    """Moments of weeks merged from the stored moments of their days."""
    days = day_moments(hourly_metrics(t)).withColumn("week", F.date_trunc("week", F.col("day").cast("timestamp_ntz")))
    g = merge_days(days, ["metric_name", "week"])
    return g.select("metric_name", "week", "n", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 6).alias("sd"))
