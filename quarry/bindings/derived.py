"""Platform-shaped tables derived from the driver tables, so the catalogue / pipeline / run
operators have inputs whose size grows with the data.

* pipelines: one per customer (``pipe_<custkey>``), tags ``source:<nation>`` and
  ``output:<segment>``, soft-deleted when the account balance is negative;
* runs: one per event (``pipe_<user_id>``), state from the event type;
* catalogue: regions (bronze), nations (silver) and market segments (gold) as datasets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

PIPELINES_SQL = """
SELECT 'pipe_' || CAST(c_custkey AS VARCHAR) AS dag_id, lower(c_mktsegment) || '@example.org' AS owner_email,
       lower(c_mktsegment) AS owner_alias, TIMESTAMP '2024-01-01' + to_days(CAST(c_nationkey AS INTEGER)) AS deployed_at,
       CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-20' END AS deleted_at, c_mktsegment = 'MACHINERY' AS is_paused,
       ['source:' || n_name, 'output:' || c_mktsegment] AS tags
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

RUNS_SQL = """
SELECT 'pipe_' || CAST(user_id AS VARCHAR) AS dag_id,
       CASE event_type WHEN 'click' THEN 'manual__' WHEN 'signup' THEN 'backfill__' ELSE 'scheduled__' END
         || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '_' || CAST(event_id AS VARCHAR) AS dag_run_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued' ELSE 'success' END AS state,
       ts AS start_date, date_trunc('hour', ts) AS logical_date, value * 60.0 AS duration_s
FROM events
"""

CATALOGUE_SQL = """
SELECT lower(r_name) AS name, 'bronze' AS schema, 'bronze' AS layer FROM region
UNION ALL SELECT DISTINCT lower(n_name), 'silver', 'silver' FROM nation
UNION ALL SELECT DISTINCT lower(c_mktsegment), 'gold', 'gold' FROM customer
"""


def pipelines(t):
    c, n = t.customer, t.nation
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.concat(F.lit("pipe_"), F.col("c_custkey").cast("string")).alias("dag_id"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("owner_email"),
        F.lower("c_mktsegment").alias("owner_alias"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("c_nationkey"))).alias("deployed_at"),
        F.when(F.col("c_acctbal") < 0, F.lit("2024-01-20").cast("timestamp_ntz")).alias("deleted_at"),
        (F.col("c_mktsegment") == "MACHINERY").alias("is_paused"),
        F.array(F.concat(F.lit("source:"), F.col("n_name")), F.concat(F.lit("output:"), F.col("c_mktsegment"))).alias("tags"))


def runs(t):
    e = t.events
    prefix = (F.when(F.col("event_type") == "click", "manual__").when(F.col("event_type") == "signup", "backfill__")
              .otherwise("scheduled__"))
    state = (F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running")
             .when(F.col("event_type") == "signup", "queued").otherwise("success"))
    return e.select(
        F.concat(F.lit("pipe_"), F.col("user_id").cast("string")).alias("dag_id"),
        F.concat(prefix, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("_"), F.col("event_id").cast("string")).alias("dag_run_id"),
        state.alias("state"), F.col("ts").alias("start_date"), F.date_trunc("hour", "ts").alias("logical_date"),
        (F.col("value") * 60.0).alias("duration_s"))


def catalogue(t):
    r = t.region.select(F.lower("r_name").alias("name"), F.lit("bronze").alias("schema"), F.lit("bronze").alias("layer"))
    n = t.nation.select(F.lower("n_name").alias("name"), F.lit("silver").alias("schema"), F.lit("silver").alias("layer")).distinct()
    s = t.customer.select(F.lower("c_mktsegment").alias("name"), F.lit("gold").alias("schema"), F.lit("gold").alias("layer")).distinct()
    return r.unionByName(n).unionByName(s)
