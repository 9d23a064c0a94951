"""Flagship: orders -> daily slot stamp -> R1, R2, R3, R6 per slot in one pass -> A5 summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_date_key
from ..operators.summary import summary_by_rules
from ..quality.engine import evaluate_by
from ..quality.rules import AcceptedValues, NotNull, RunContext, UniqueKey, ValueRange
from ..sinks.stamp import stamp_datekey
from . import Registry

REG = Registry()


def orders_rules():
    return [
        NotNull("orders_keys_not_null", columns=["o_orderkey", "o_custkey"]),
        ValueRange("orders_total_range", "o_totalprice", min=1000, max=450000, severity="critical"),
        AcceptedValues("orders_status_set", "o_orderstatus", ["O", "F"], severity="warning"),
        UniqueKey("orders_customer_once_per_day", ["o_custkey"], severity="info"),
    ]


def slot_results(orders: DataFrame) -> DataFrame:
    """Rule rows for every daily slot of ``orders``: a grouped scan, and a key-only pass."""
    stamped = stamp_datekey(orders, time_col="o_orderdate")
    ctx = RunContext(orders.sparkSession, warn_on_warning=True)
    res = evaluate_by(stamped, orders_rules(), ["__date"], ctx)
    return res.select(
        F.lit("silver/orders").alias("dataset"),
        F.col("__date").alias("run_id"),
        parse_date_key("__date").alias("run_timestamp"),
        "rule_name", "rule_type", "severity", "status", "actual_value", "expected_value", "affected_rows",
        "check_family")


def flagship(orders: DataFrame) -> DataFrame:
    return summary_by_rules(slot_results(orders))


_SLOT_SQL = """
WITH o AS (SELECT *, strftime(o_orderdate, '%d_%m_%Y_%H') AS d FROM orders),
nn AS (
  SELECT d, sum(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) AS n
  FROM o GROUP BY d),
vr AS (SELECT d, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 450000) AS n FROM o GROUP BY d),
av AS (SELECT d, count(*) FILTER (WHERE NOT o_orderstatus IN ('O', 'F')) AS n FROM o GROUP BY d),
uk AS (SELECT d, sum(c) - count(*) AS n FROM (SELECT d, o_custkey, count(*) AS c FROM o GROUP BY d, o_custkey) GROUP BY d),
r AS (
  SELECT d, 'orders_keys_not_null' AS rule_name, 'not_null' AS rule_type, 'critical' AS severity,
         CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(n AS VARCHAR) AS actual_value,
         '0' AS expected_value, n AS affected_rows, 'content' AS check_family FROM nn
  UNION ALL
  SELECT d, 'orders_total_range', 'value_range', 'critical', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END,
         CAST(n AS VARCHAR) || ' out-of-range', '>=1000 and <=450000', n, 'content' FROM vr
  UNION ALL
  SELECT d, 'orders_status_set', 'accepted_values', 'warning', CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END,
         CAST(n AS VARCHAR) || ' invalid', '[''O'', ''F'']', n, 'content' FROM av
  UNION ALL
  SELECT d, 'orders_customer_once_per_day', 'unique_key', 'info', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END,
         CAST(n AS VARCHAR) || ' duplicates', '0 duplicates', n, 'content' FROM uk)
"""

SLOT_ORACLE = _SLOT_SQL + """
SELECT 'silver/orders' AS dataset, d AS run_id, strptime(d, '%d_%m_%Y_%H') AS run_timestamp,
       rule_name, rule_type, severity, status, actual_value, expected_value, CAST(affected_rows AS BIGINT) AS affected_rows,
       check_family
FROM r
"""

FLAGSHIP_ORACLE = _SLOT_SQL + """,
per_run AS (
  SELECT d, strptime(d, '%d_%m_%Y_%H') AS seen_at, bool_or(status = 'FAIL' AND severity = 'critical') AS blocked,
         bool_or(status = 'WARN') AS warned
  FROM r GROUP BY d)
SELECT 'silver/orders' AS dataset, count(*) AS total_runs, round(avg(CAST(NOT blocked AND NOT warned AS INTEGER)), 4) AS pass_rate,
       max(seen_at) AS last_run_at, count(*) FILTER (WHERE blocked) AS critical_failures,
       count(*) FILTER (WHERE warned) AS warnings,
       arg_max(CASE WHEN blocked THEN 'FAIL' WHEN warned THEN 'WARN' ELSE 'PASS' END, (seen_at, d)) AS last_status
FROM per_run
"""


@REG.query("flagship_orders_quality", oracle=FLAGSHIP_ORACLE)
def _flagship(t):
    """A5 over per-slot R1/R2/R3/R6 results of orders."""
    return flagship(t.orders)


@REG.query("r17_slot_rule_results", oracle=SLOT_ORACLE)
def _slots(t):
    """Rule-result rows of every daily slot of orders (R1, R2, R3, R6 fused per slot)."""
    return slot_results(t.orders)
