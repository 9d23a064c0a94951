"""Bindings for metric bins, service levels, JSON logs and cost.

Metric points and log lines are derived from ``events``; usage rows from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slo as O
from . import Registry

REG = Registry()


def points(t):
    e = t.events
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return e.select(F.col("ts").alias("TimeGenerated"), F.col("event_type").alias("Name"), F.col("value").alias("Val"),
                    F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("status"), status).alias("Tags"))


def good():
    return F.col("Tags")["status"] == "success"


def logs(t):
    e = t.events
    et = F.col("event_type")
    msg = F.to_json(F.struct(
        F.concat(F.lit("pipe_"), F.col("user_id").cast("string")).alias("pipeline_id"),
        F.when(et == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("silver/"), et).alias("dataset"),
        F.when((et == "purchase") & (F.col("value") > 100), 503).when(et == "purchase", 200).alias("status_code"),
        F.when((et == "error") | ((et == "click") & (F.col("value") > 200)),
               F.concat(F.lit("DQ_CRITICAL_FAILURE k="), F.get_json_object("props", "$.k")))
        .otherwise(F.concat(F.lit("ok "), F.col("event_id").cast("string"))).alias("message"),
        F.lit("GET").alias("method"), F.concat(F.lit("/api/"), et).alias("path")))
    text = F.when((et == "view") & (F.col("value") < 2), F.lit("heartbeat ok")).otherwise(msg)
    return e.select(F.col("ts").alias("TimeGenerated"), F.lit("aks-lake").alias("ClusterName"),
                    F.when(et == "error", "airflow").when(et == "purchase", "portal").otherwise("spark-jobs").alias("Namespace"),
                    F.when(et == "purchase", "portal-api").otherwise("worker").alias("ContainerName"),
                    text.alias("LogMessage"))


@REG.query("a15_percentile_by_bin", oracle="""
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bin, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1
""")
def _a15(t):
    """P95 of the value per 10-minute bin (exact)."""
    return O.percentile_by_bin(points(t), 0.95, "10 minutes", exact=True).withColumn("p95", F.round("p95", 6))


@REG.query("a15_percentile_by_bin_approx")
def _a15b(t):
    """P95 per hour with the approximate sketch (rows-only check)."""
    return O.percentile_by_bin(points(t), 0.95, "1 hour", exact=False)


@REG.query("a16_ratio_by_bin", oracle="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bin, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END), 6) AS good,
       round(sum(value), 6) AS total,
       round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END) / nullif(sum(value), 0.0), 6) AS ratio
FROM events GROUP BY 1
""")
def _a16(t):
    """Success ratio (sumif / sum) per hour."""
    r = O.ratio_by_bin(points(t), good(), "1 hour")
    return r.select("bin", F.round("good", 6).alias("good"), F.round("total", 6).alias("total"), F.round("ratio", 6).alias("ratio"))


@REG.query("a17_counter_rate", oracle="""
WITH p AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bin, event_type AS Name, value,
                  lag(value) OVER (PARTITION BY time_bucket(INTERVAL 5 MINUTE, ts), event_type ORDER BY ts, value) AS pv FROM events)
SELECT bin, Name, round(sum(CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END) / 300.0, 6) AS rate_per_s
FROM p GROUP BY ALL
""")
def _a17(t):
    """Counter rate per 5 minutes and metric name; the values fall often, as after resets."""
    r = O.counter_rate(points(t), ["Name"], "5 minutes")
    return r.select("bin", "Name", F.round("rate_per_s", 6).alias("rate_per_s"))


@REG.query("o1_service_level", oracle="""
WITH h AS (SELECT '1 hour' AS "window", time_bucket(INTERVAL 1 HOUR, ts) AS bin,
                  sum(CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END) AS good, sum(value) AS total, 14.4 AS thr, 'critical' AS sev
           FROM events GROUP BY 2
           UNION ALL
           SELECT '6 hours', time_bucket(INTERVAL 6 HOUR, ts), sum(CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END), sum(value),
                  3.0, 'warning' FROM events GROUP BY 2),
b AS (SELECT *, good / nullif(total, 0.0) AS sli, (1.0 - good / nullif(total, 0.0)) / 0.01 AS burn FROM h)
SELECT "window", bin, round(sli, 6) AS sli, round(burn, 6) AS burn_rate, burn > thr AS alert,
       CASE WHEN burn > thr THEN sev END AS severity
FROM b
""")
def _o1(t):
    """O1: SLI, error budget and burn rate per 1 h / 6 h bin with fast / slow alerts."""
    s = O.service_level(points(t), good(), 0.99)
    return s.select("window", "bin", F.round("sli", 6).alias("sli"), F.round("burn_rate", 6).alias("burn_rate"), "alert", "severity")


@REG.query("o2_freshness_share", oracle="""
WITH d AS (SELECT event_type AS dataset, max(ts) AS last_updated FROM events GROUP BY 1),
l AS (SELECT event_type AS dataset, CASE WHEN event_type = 'error' THEN 12.0 ELSE 24.0 END AS max_age_hours FROM events GROUP BY 1)
SELECT count(*) AS datasets,
       count(*) FILTER (WHERE (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(last_updated)) / 3.6e9 <= max_age_hours) AS fresh,
       round(avg(CASE WHEN (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(last_updated)) / 3.6e9 <= max_age_hours THEN 1.0 ELSE 0.0 END), 6) AS fresh_share
FROM d JOIN l USING (dataset)
""")
def _o2(t):
    """O2: share of datasets (event types) updated within their limit."""
    e = t.events
    d = e.groupBy(F.col("event_type").alias("dataset")).agg(F.max("ts").alias("last_updated"))
    lim = e.groupBy(F.col("event_type").alias("dataset")).agg(
        F.when(F.first("event_type") == "error", 12.0).otherwise(24.0).alias("max_age_hours"))
    return O.freshness_share(d, lim, "2024-01-31 12:00:00").withColumn("fresh_share", F.round("fresh_share", 6))


@REG.query("o3_trace", oracle="""
SELECT ts AS TimeGenerated, 'aks-lake' AS ClusterName,
       CASE event_type WHEN 'error' THEN 'airflow' WHEN 'purchase' THEN 'portal' ELSE 'spark-jobs' END AS Namespace,
       CASE WHEN event_type = 'purchase' THEN 'portal-api' ELSE 'worker' END AS ContainerName,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       CASE WHEN event_type = 'error' OR (event_type = 'click' AND value > 200)
            THEN 'DQ_CRITICAL_FAILURE k=' || json_extract_string(props, '$.k') ELSE 'ok ' || CAST(event_id AS VARCHAR) END AS message
FROM events WHERE user_id = 7 AND NOT (event_type = 'view' AND value < 2)
""")
def _o3(t):
    """O3: time-ordered trace of one pipeline id across components."""
    return O.trace(logs(t), "pipe_7")


@REG.query("o4_server_errors", oracle="""
SELECT ts AS TimeGenerated, 'GET' AS method, '/api/purchase' AS path, '503' AS status_code, CAST(NULL AS VARCHAR) AS error
FROM events WHERE event_type = 'purchase' AND value > 100 AND ts > TIMESTAMP '2024-01-25 00:00:00'
""")
def _o4(t):
    """5xx lines since a time, fields read from JSON."""
    return O.server_errors(logs(t), "2024-01-25 00:00:00")


@REG.query("a21_log_failures", oracle="""
SELECT 'silver/' || event_type AS dataset, count(*) AS count FROM events
WHERE event_type = 'error' OR (event_type = 'click' AND value > 200) GROUP BY 1
""")
def _a21(t):
    """DQ_CRITICAL_FAILURE lines counted by the JSON dataset field."""
    return O.log_failures(logs(t), "DQ_CRITICAL_FAILURE", "dataset")


def usage(t):
    return t.lineitem.select(F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("ResourceType"),
                             F.nullif("l_linestatus", F.lit("O")).alias("pipeline"),
                             F.col("l_extendedprice").alias("Cost"), F.lit("USD").alias("Currency"))


@REG.query("a18_cost_by_tag", oracle="""
SELECT coalesce(nullif(l_linestatus, 'O'), 'untagged') AS pipeline, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1
""")
def _a18(t):
    """Cost by pipeline tag with an untagged default."""
    return O.cost_by(usage(t), "pipeline")


@REG.query("a18_cost_by_resource_top", oracle="""
SELECT l_returnflag || '/' || l_linestatus AS ResourceType, round(sum(l_extendedprice), 2) AS cost FROM lineitem
GROUP BY 1 ORDER BY cost DESC, ResourceType LIMIT 5
""")
def _a18b(t):
    """Top 5 resource types by cost."""
    return O.cost_by(usage(t), "ResourceType", k=5)


@REG.query("o5_run_cost", oracle="""
WITH p AS (SELECT event_type AS node_type, round(avg(value) / 100, 4) AS dp, round(avg(value) / 50, 4) AS ep FROM events GROUP BY 1),
r AS (SELECT event_type AS node_type, value * 60 AS ds, value * 120 AS es, 2 AS ex FROM events)
SELECT r.node_type, count(*) AS runs, round(sum(round((ds * dp + es * ex * ep) / 3600.0, 4)), 2) AS cost
FROM r LEFT JOIN p USING (node_type) GROUP BY 1
""")
def _o5(t):
    """Run cost from driver / executor seconds and a price table by node type."""
    e = t.events
    prices = e.groupBy(F.col("event_type").alias("node_type")).agg(
        F.round(F.avg("value") / 100, 4).alias("driver_price_per_hour"),
        F.round(F.avg("value") / 50, 4).alias("executor_price_per_hour"))
    runs = e.select(F.col("event_type").alias("node_type"), (F.col("value") * 60).alias("driver_seconds"),
                    (F.col("value") * 120).alias("executor_seconds"), F.lit(2).alias("executors"))
    c = O.run_cost(runs, prices)
    return c.groupBy("node_type").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("cost"), 2).alias("cost"))
