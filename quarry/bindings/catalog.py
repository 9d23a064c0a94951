"""Bindings for catalogue, dataset cards, contracts, preview and pipeline registry
(C1, C2, C4, C5, G1, G2, A20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..session import TABLES
from . import Registry
from .derived import PIPELINES_SQL, RUNS_SQL, pipelines, runs
from .quality import EXPECTED_ORDERS, _SCHEMA_TYPES_SQL, sql_row

REG = Registry()


@REG.query("c1_table_schema", oracle=f"""
SELECT table_name AS "table", column_name AS "column", {_SCHEMA_TYPES_SQL} AS type, true AS nullable,
       CAST(ordinal_position - 1 AS INTEGER) AS position
FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{n}'" for n in TABLES)})
""")
def _c1(t):
    """Columns of every driver table (nested fields flattened), from the scan schemas."""
    return C.table_schema(t.spark, {n: t[n] for n in TABLES})


@REG.query("c2_dataset_cards", oracle="""
SELECT 'orders' AS dataset, count(*) AS row_count, max(o_orderdate) AS last_updated, true AS has_dq FROM orders
UNION ALL SELECT 'lineitem', count(*), max(l_shipdate), true FROM lineitem
UNION ALL SELECT 'events', count(*), max(ts), false FROM events
UNION ALL SELECT 'customer', count(*), NULL, false FROM customer
""")
def _c2(t):
    """Dataset cards: count and last update in one scan per table, has-DQ flag."""
    from .summaries import all_results

    summaries = all_results(t).select(F.regexp_replace("dataset", "^silver/", "").alias("dataset")).distinct()
    return C.dataset_cards({n: t[n] for n in ["orders", "lineitem", "events", "customer"]}, summaries)


@REG.query("c4_check_contract", oracle=f"""
WITH k AS (SELECT sum(c) - count(*) AS n FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)),
f AS (SELECT round((epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(max(o_orderdate))) / 3600000000.0, 2) AS h FROM orders)
{sql_row('contract_grain', 'unique_key', 'critical', 'n > 0', "CAST(n AS VARCHAR) || ' duplicates'", '0 duplicates', 'n')} FROM k
UNION ALL {sql_row('contract_schema', 'schema', 'critical', 'true', '3', '0', '3', 'schema')}
UNION ALL {sql_row('contract_cadence', 'max_staleness_hours', 'critical', 'h IS NULL OR h > 24.0', 'h', '<=24.0', '0', 'freshness')} FROM f
UNION ALL {sql_row('contract_partition_key', 'schema', 'critical', 'false', '0', '0', '0', 'schema')}
""")
def _c4(t):
    """C4: contract = unique grain + schema + cadence + partition key."""
    contract = {"grain": ["o_orderkey"], "schema": EXPECTED_ORDERS, "time_column": "o_orderdate", "max_age_hours": 24,
                "partition_keys": ["o_orderdate"]}
    r = C.check_contract(t.orders, contract, as_of="2001-08-02 00:00:00")
    return r.select("rule_name", "rule_type", "severity", "status", "actual_value", "expected_value", "affected_rows",
                    "check_family")


@REG.query("c5_preview", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity > 45
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 100
""")
def _c5(t):
    """Filtered, projected, ordered preview of 100 rows."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return C.preview(t.lineitem, F.col("l_quantity") > 45, cols, 100, cols)


@REG.query("g1_owned_dags", oracle=f"""
WITH p AS ({PIPELINES_SQL}),
s AS (SELECT 'pipe_' || CAST(s_suppkey AS VARCHAR) AS dag_id, 'supplier@example.org' AS owner_email FROM supplier),
u AS (SELECT p.dag_id, CASE WHEN s.dag_id IS NOT NULL THEN s.owner_email ELSE p.owner_email END AS owner_email, p.deleted_at
      FROM p LEFT JOIN s ON p.dag_id = s.dag_id
      UNION ALL SELECT s.dag_id, s.owner_email, NULL FROM s WHERE s.dag_id NOT IN (SELECT dag_id FROM p)),
d AS (SELECT u.dag_id, u.owner_email,
             CASE WHEN u.dag_id IN (SELECT 'pipe_' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 0)
                  THEN coalesce(u.deleted_at, TIMESTAMP '2024-02-01') ELSE u.deleted_at END AS deleted_at FROM u)
SELECT owner_email, count(*) AS pipelines, min(dag_id) AS first_dag_id FROM d WHERE deleted_at IS NULL GROUP BY 1
""")
def _g1(t):
    """G1: register (upsert) supplier-owned pipelines, soft-delete one nation's, owners' counts."""
    reg = pipelines(t).select("dag_id", "owner_email", "deleted_at")
    new = t.supplier.select(F.concat(F.lit("pipe_"), F.col("s_suppkey").cast("string")).alias("dag_id"),
                            F.lit("supplier@example.org").alias("owner_email"),
                            F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    # an update keeps the registry's deletion mark: take it from the current row
    new = new.join(reg.select("dag_id", F.col("deleted_at").alias("__d")), "dag_id", "left") \
        .select("dag_id", "owner_email", F.col("__d").alias("deleted_at"))
    reg = C.register_pipeline(reg, new)
    gone = t.customer.filter("c_nationkey = 0").select(F.concat(F.lit("pipe_"), F.col("c_custkey").cast("string")).alias("dag_id"))
    reg = C.soft_delete(reg, gone, "2024-02-01 00:00:00")
    return C.owned(reg)


@REG.query("g2_dag_cards", oracle=f"""
WITH p AS ({PIPELINES_SQL}), r AS ({RUNS_SQL}),
l AS (SELECT dag_id, arg_max(state, (start_date, dag_run_id)) AS last_state FROM r GROUP BY 1),
c AS (SELECT p.*, l.last_state, p.deleted_at IS NULL AND NOT p.is_paused AS is_active, l.last_state = 'failed' AS last_failed
      FROM p LEFT JOIN l USING (dag_id))
SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_paused) AS paused,
       count(*) FILTER (WHERE last_failed) AS failed FROM c
""")
def _g2(t):
    """Pipeline cards with last run, then active / paused / failed totals."""
    return C.pipeline_counts(C.pipeline_cards(pipelines(t), runs(t)))
