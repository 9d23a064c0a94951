"""Bindings for result summaries and general aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import parse_date_key
from ..operators import summary as S
from ..quality.engine import evaluate_by
from ..quality.gate import run_status
from ..quality.history import slot_metrics
from ..quality.rules import AcceptedValues, NotNull, RunContext, ValueRange
from ..sinks.stamp import stamp_datekey
from . import Registry
from .flagship import _SLOT_SQL, slot_results

REG = Registry()
AS_OF = "2001-08-01 00:00:00"


def lineitem_slot_results(t):
    l = stamp_datekey(t.lineitem, time_col="l_shipdate")
    rules = [NotNull("qty_not_null", column="l_quantity"),
             ValueRange("discount_cap", "l_discount", max=0.09, severity="warning"),
             AcceptedValues("flag_set", "l_returnflag", ["A", "N"], severity="critical")]
    r = evaluate_by(l, rules, ["__date"], RunContext(t.spark, warn_on_warning=True))
    return r.select(F.lit("silver/lineitem").alias("dataset"), F.col("__date").alias("run_id"),
                    parse_date_key("__date").alias("run_timestamp"), "rule_name", "rule_type", "severity", "status")


def all_results(t):
    o = slot_results(t.orders).select("dataset", "run_id", "run_timestamp", "rule_name", "rule_type", "severity", "status")
    return S.union_results({"silver/orders": o.drop("dataset"), "silver/lineitem": lineitem_slot_results(t).drop("dataset")})


RESULTS_SQL = _SLOT_SQL + """,
l AS (SELECT *, strftime(l_shipdate, '%d_%m_%Y_%H') AS d FROM lineitem),
lr AS (
  SELECT d, 'qty_not_null' AS rule_name, 'not_null' AS rule_type, 'critical' AS severity,
         CASE WHEN count(*) FILTER (WHERE l_quantity IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM l GROUP BY d
  UNION ALL
  SELECT d, 'discount_cap', 'value_range', 'warning',
         CASE WHEN count(*) FILTER (WHERE l_discount > 0.09) > 0 THEN 'WARN' ELSE 'PASS' END FROM l GROUP BY d
  UNION ALL
  SELECT d, 'flag_set', 'accepted_values', 'critical',
         CASE WHEN count(*) FILTER (WHERE NOT l_returnflag IN ('A', 'N')) > 0 THEN 'FAIL' ELSE 'PASS' END FROM l GROUP BY d),
rr AS (
  SELECT 'silver/orders' AS dataset, d AS run_id, strptime(d, '%d_%m_%Y_%H') AS run_timestamp, rule_name, rule_type, severity, status FROM r
  UNION ALL
  SELECT 'silver/lineitem', d, strptime(d, '%d_%m_%Y_%H'), rule_name, rule_type, severity, status FROM lr)
"""

A5_SQL = """
per_run AS (
  SELECT dataset, run_id, max(run_timestamp) AS seen_at, bool_or(status = 'FAIL' AND severity = 'critical') AS blocked,
         bool_or(status = 'WARN') AS warned
  FROM rr GROUP BY dataset, run_id),
a5 AS (
  SELECT dataset, count(*) AS total_runs, round(avg(CAST(NOT blocked AND NOT warned AS INTEGER)), 4) AS pass_rate,
         max(seen_at) AS last_run_at, count(*) FILTER (WHERE blocked) AS critical_failures,
         count(*) FILTER (WHERE warned) AS warnings,
         arg_max(CASE WHEN blocked THEN 'FAIL' WHEN warned THEN 'WARN' ELSE 'PASS' END, (seen_at, run_id)) AS last_status
  FROM per_run GROUP BY dataset)
"""


@REG.query("a5_summary_by_rules", oracle=RESULTS_SQL + "," + A5_SQL + "SELECT * FROM a5")
def _a5(t):
    """A5: two-level run -> dataset summary over two datasets' rule results."""
    return S.summary_by_rules(all_results(t))


@REG.query("u1_union_results", oracle=RESULTS_SQL + """
SELECT dataset, rule_type, status, count(*) AS n, count(DISTINCT run_id) AS runs FROM rr GROUP BY ALL
""")
def _u1(t):
    """Union of rule tables tagged by dataset (checked through a grouped count)."""
    return all_results(t).groupBy("dataset", "rule_type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"))


RUN_SUMMARY_SQL = """
rs AS (
  SELECT dataset, run_id, max(run_timestamp) AS run_at, count(*) AS total_rules,
         count(*) FILTER (WHERE status = 'PASS') AS passes,
         coalesce(array_to_string(list_sort(list(rule_name) FILTER (WHERE status = 'FAIL' AND severity = 'critical')), ','), '') AS critical_failures,
         count(*) FILTER (WHERE status = 'WARN') AS warnings,
         CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL'
              WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS overall_status
  FROM rr GROUP BY dataset, run_id)
"""


def run_summaries(t):
    s = run_status(all_results(t), ["dataset", "run_id"])
    return s.select(
        "dataset", "run_id", "run_at", "total_rules", "passes",
        F.array_join("critical_failures", ",").alias("critical_failures"), "warnings", "overall_status")


@REG.query("a6_summary_by_runs", oracle=RESULTS_SQL + "," + RUN_SUMMARY_SQL + """
SELECT dataset, count(*) AS total_runs,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE overall_status = 'PASS') / count(*), 4) ELSE 0.0 END AS pass_rate,
       max(run_at) AS last_run_at, count(*) FILTER (WHERE critical_failures <> '') AS critical_failures,
       CAST(sum(warnings) AS BIGINT) AS warnings, arg_max(overall_status, (run_at, run_id)) AS last_status
FROM rs GROUP BY dataset
""")
def _a6(t):
    """Dataset summary from run-summary rows (PASS-count form)."""
    return S.summary_by_runs(run_summaries(t))


def event_metrics(t):
    return slot_metrics(t.events, F.to_date("ts").cast("timestamp_ntz"), ["event_type"], "bronze/events") \
        .filter(F.col("metric_name") == "rows_written").withColumnRenamed("dataset_path", "dataset")


MON_SQL = """
mon AS (SELECT 'bronze/events' AS dataset, count(*) AS total_runs, CAST(NULL AS DOUBLE) AS pass_rate,
               max(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS last_run_at, CAST(0 AS BIGINT) AS critical_failures,
               CAST(0 AS BIGINT) AS warnings, 'MONITORED' AS last_status
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS ts FROM events))
"""


@REG.query("a7_monitored_only", oracle="WITH " + MON_SQL + "SELECT * FROM mon")
def _a7(t):
    """Datasets with profiles and no rules (events) shown as MONITORED."""
    s = S.summary_by_rules(all_results(t))
    m = event_metrics(t).unionByName(
        slot_metrics(t.orders, F.to_date("o_orderdate").cast("timestamp_ntz"), [], "silver/orders")
        .withColumnRenamed("dataset_path", "dataset"))
    return S.monitored_only(m, s)


def overview(t):
    return S.dq_overview(all_results(t), event_metrics(t))


@REG.query("u2_dq_overview", oracle=RESULTS_SQL + "," + A5_SQL + "," + MON_SQL +
           "SELECT * FROM a5 UNION ALL SELECT * FROM mon")
def _u2(t):
    """Rules summary united with the monitored fallback."""
    return overview(t)


@REG.query("a8_platform_quality", oracle=RESULTS_SQL + "," + A5_SQL + "," + MON_SQL + """,
u AS (SELECT * FROM a5 UNION ALL SELECT * FROM mon)
SELECT count(*) AS datasets, CAST(round(avg(pass_rate) * 100) AS BIGINT) AS avg_pass_pct,
       round(coalesce(avg(pass_rate), 0.0), 6) AS overall_pass_rate,
       count(*) FILTER (WHERE last_status NOT IN ('PASS', 'MONITORED') OR critical_failures > 0) AS issues,
       count(*) FILTER (WHERE critical_failures > 0) AS critical_datasets,
       count(*) FILTER (WHERE last_status = 'PASS') AS pass_count, count(*) FILTER (WHERE last_status = 'FAIL') AS fail_count,
       count(*) FILTER (WHERE last_status = 'WARN') AS warn_count, count(*) FILTER (WHERE last_status = 'MONITORED') AS monitored_count
FROM u
""")
def _a8(t):
    """Platform numbers over the overview."""
    return S.platform_quality(overview(t)).withColumn("overall_pass_rate", F.round("overall_pass_rate", 6))


@REG.query("a9_pass_rate_trend", oracle=RESULTS_SQL + f"""
SELECT CAST(run_timestamp AS DATE) AS day, count(*) AS checks, count(*) FILTER (WHERE status = 'PASS') AS passed,
       round(count(*) FILTER (WHERE status = 'PASS') * 100.0 / count(*), 2) AS pass_pct
FROM rr WHERE run_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1
""")
def _a9(t):
    """Pass-rate trend by day over 30 days before as-of."""
    return S.pass_rate_trend(all_results(t), 30, AS_OF)


@REG.query("a10_worst_datasets", oracle=RESULTS_SQL + f"""
SELECT dataset, count(*) AS checks, count(*) FILTER (WHERE status = 'FAIL') AS failures,
       count(*) FILTER (WHERE status = 'PASS') AS passes,
       round(count(*) FILTER (WHERE status = 'PASS') * 100.0 / nullif(count(*), 0), 2) AS pass_pct
FROM rr WHERE run_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY dataset
ORDER BY pass_pct ASC NULLS LAST, failures DESC, dataset LIMIT 20
""")
def _a10(t):
    """A10: worst datasets over 7 days, NULLIF guard, top 20."""
    return S.worst_datasets(all_results(t), 7, 20, AS_OF)


@REG.query("a11_rule_failures", oracle=RESULTS_SQL + f"""
SELECT dataset, rule_name, rule_type, count(*) AS evaluations, count(*) FILTER (WHERE status = 'FAIL') AS failures,
       count(*) FILTER (WHERE status = 'WARN') AS warnings, max(run_timestamp) FILTER (WHERE status = 'FAIL') AS last_failure
FROM rr WHERE run_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY ALL
""")
def _a11(t):
    """Per-rule failures over 90 days with conditional counts."""
    return S.rule_failures(all_results(t), 90, AS_OF)


@REG.query("a3_row_count", oracle="SELECT count(*) AS row_count FROM lineitem")
def _a3(t):
    """A3: global count."""
    return S.row_count(t.lineitem)


@REG.query("a4_distinct_keys", oracle="""
SELECT count(*) AS distinct_keys, sum(n) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
""")
def _a4(t):
    """A4: distinct key rows."""
    return S.distinct_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@REG.query("a12_daily_volume", oracle="""
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS rows, round(sum(o_totalprice), 2) AS amount, count(DISTINCT o_custkey) AS entities
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
""")
def _a12(t):
    """Daily count, sum and exact distinct customers of finished orders."""
    v = S.daily_volume(t.orders, "o_orderdate", "o_totalprice", "o_custkey", F.col("o_orderstatus") == "F")
    return v.withColumn("amount", F.round("amount", 2))


@REG.query("a13_group_stats", oracle="""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_value FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL
""")
def _a13(t):
    """Count and mean per group inside one yearly slot."""
    slot = (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & \
           (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    g = S.group_stats(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", slot)
    return g.withColumn("mean_value", F.round("mean_value", 6))


@REG.query("a14_quantile_exact", oracle="""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1
""")
def _a14(t):
    """A14 exact twin: P99 per flag with linear interpolation."""
    q = S.exact_quantile(t.lineitem, "l_extendedprice", 0.99, ["l_returnflag"])
    return q.withColumn("p99", F.round("p99", 6))


@REG.query("a14_quantile_approx")
def _a14b(t):
    """Approximate P99 per flag (sketch; rows-only check)."""
    return S.quantile_metric(t.lineitem, "l_extendedprice", 0.99, 10000, ["l_returnflag"])


@REG.query("a19_last_updated", oracle="SELECT 'o_orderdate' AS column, max(o_orderdate) AS last_updated FROM orders")
def _a19(t):
    """Max of the first known time column from a candidate list."""
    return S.last_updated(t.orders, ["updated_at", "_ingestion_date", "o_orderdate"]).select(
        "column", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@REG.query("a20_counts_by", oracle="""
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) AS total,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_totalprice > 300000) AS large
FROM orders
""")
def _a20(t):
    """Counts per status as columns plus conditional totals."""
    return S.counts_by(t.orders, "o_orderstatus", {"urgent": F.col("o_orderpriority") == "1-URGENT",
                                                   "large": F.col("o_totalprice") > 300000}, ["F", "O", "P"])


@REG.query("u3_distinct_names", oracle="SELECT DISTINCT p_brand FROM part")
def _u3(t):
    """Distinct names."""
    return S.distinct_names(t.part, "p_brand")
