"""Bindings for restatement and tracking (B1-B6, K10) on orders-derived registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import restate as R
from ..session import scratch_path
from ..sinks import writers as W
from . import Registry
from .lineage import DAG_EDGES_SQL, dag_edges

REG = Registry()
AS_OF = "2001-08-01 00:00:00"


def registry(t):
    o = t.orders
    d = F.to_date("o_orderdate")
    return o.select(
        F.concat(F.lit("rs_"), F.col("o_orderkey").cast("string")).alias("restatement_id"),
        F.lower("o_orderpriority").alias("dataset_id"), F.col("o_orderdate").alias("triggered_at"),
        d.alias("date_range_start"), F.date_add(d, F.floor(F.col("o_totalprice") / 20000).cast("int")).alias("date_range_end"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
        .otherwise("pending").alias("status"),
        F.floor("o_totalprice").cast("long").alias("rows_before"),
        F.floor(F.col("o_totalprice") * 1.01).cast("long").alias("rows_after"))


REGISTRY_SQL = """
reg AS (SELECT 'rs_' || CAST(o_orderkey AS VARCHAR) AS restatement_id, lower(o_orderpriority) AS dataset_id,
               o_orderdate AS triggered_at, CAST(o_orderdate AS DATE) AS date_range_start,
               CAST(o_orderdate AS DATE) + CAST(floor(o_totalprice / 20000) AS INTEGER) AS date_range_end,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
               CAST(floor(o_totalprice) AS BIGINT) AS rows_before, CAST(floor(o_totalprice * 1.01) AS BIGINT) AS rows_after
        FROM orders)
"""


def tracker(t):
    """An append-only tracker: a marker per order (its day is the slot), so slots have retries."""
    o = t.orders
    status = (F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_totalprice") > 350000, "DQ_FAILED")
              .otherwise("success"))
    at = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    s = o.select(F.lit("silver/orders").alias("dataset"), F.lit("silver").alias("layer"), F.to_date("o_orderdate").alias("slot"),
                 status.alias("status"), at.alias("completed_at"))
    b = (t.lineitem.select(F.to_date("l_shipdate").alias("slot")).distinct()
         .select(F.lit("bronze/lineitem").alias("dataset"), F.lit("bronze").alias("layer"), "slot", F.lit("success").alias("status"),
                 F.col("slot").cast("timestamp_ntz").alias("completed_at")))
    return s.unionByName(b)


TRACKER_SQL = """
log AS (SELECT 'silver/orders' AS dataset, 'silver' AS layer, CAST(o_orderdate AS DATE) AS slot,
               CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_totalprice > 350000 THEN 'DQ_FAILED' ELSE 'success' END AS status,
               o_orderdate + to_seconds(o_orderkey % 86400) AS completed_at FROM orders
        UNION ALL SELECT DISTINCT 'bronze/lineitem', 'bronze', CAST(l_shipdate AS DATE), 'success', CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)
        FROM lineitem),
trk AS (SELECT dataset, layer, slot, arg_max(status, (completed_at, status)) AS status FROM log GROUP BY ALL)
"""


@REG.query("b1_expand_slots", oracle="""
WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS t FROM orders)
SELECT CAST(d AS DATE) AS slot, strftime(d, '%d_%m_%Y_%H') AS date_key
FROM m, range(m.t - INTERVAL 89 DAY, m.t + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d)
""")
def _b1(t):
    """B1: the 90 daily slots ending at the newest order day (range checked per row)."""
    b = t.orders.agg(F.max(F.to_date("o_orderdate")).alias("t")).select(F.date_sub("t", 89).alias("f"), "t")
    return R.expand_slots_of(b, 90)


@REG.query("b2_restate", oracle="WITH " + TRACKER_SQL + """
SELECT dataset, layer, slot, status, completed_at FROM log
WHERE NOT (dataset = 'silver/orders' AND slot BETWEEN DATE '2001-06-01' AND DATE '2001-06-30')
""")
def _b2(t):
    """B2: clear the tracker markers of June 2001 for silver/orders."""
    slots = R.expand_slots(t.spark, "2001-06-01", "2001-06-30").select(F.lit("silver/orders").alias("dataset"), "slot")
    return R.restate(tracker(t), slots)


@REG.query("k10_pending_slots", oracle="WITH " + TRACKER_SQL + """
SELECT 'silver/orders' AS dataset, CAST(d AS DATE) AS slot FROM range(DATE '2001-05-01', DATE '2001-08-02', INTERVAL 1 DAY) r(d)
WHERE CAST(d AS DATE) NOT IN (SELECT slot FROM trk WHERE dataset = 'silver/orders' AND status = 'success')
""")
def _k10(t):
    """Slots without a success marker (left anti join), restate off."""
    cal = R.calendar(t.spark, "2001-05-01", "2001-08-01").select(F.lit("silver/orders").alias("dataset"), "slot")
    return R.pending_slots(cal, tracker(t))


@REG.query("b3_restatement_history", oracle="WITH " + REGISTRY_SQL + f"""
SELECT *, rows_after - rows_before AS row_delta FROM reg
WHERE triggered_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND dataset_id = '1-urgent'
""")
def _b3(t):
    """90-day restatement history of one dataset with the row delta."""
    return R.restatement_history(registry(t), "1-urgent", 90, AS_OF)


@REG.query("b4_conflicts", oracle="WITH " + REGISTRY_SQL + """
, a AS (SELECT dataset_id, date_range_start AS s, date_range_end AS e FROM reg WHERE status IN ('pending', 'running')),
x AS (SELECT *, max(e) OVER (PARTITION BY dataset_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM a),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id ORDER BY s, e) AS grp FROM x),
m AS (SELECT dataset_id, grp, min(s) AS busy_from, max(e) AS busy_to FROM g GROUP BY ALL)
SELECT r.dataset_id, restatement_id AS request_id, date_range_start, date_range_end, count(m.grp) > 0 AS conflict,
       count(m.grp) AS n_ranges, min(busy_from) AS busy_from, min(busy_to) AS busy_to
FROM reg r LEFT JOIN m ON r.dataset_id = m.dataset_id AND date_range_start <= busy_to AND busy_from <= date_range_end
GROUP BY ALL
""")
def _b4(t):
    """Every request with whether it overlaps an active restatement of its dataset."""
    reg = registry(t)
    return R.conflicts(reg, reg)


@REG.query("b5_cascade", oracle="WITH RECURSIVE " + DAG_EDGES_SQL + """,
ch AS (SELECT * FROM e
       UNION SELECT DISTINCT lower(o_orderpriority), 'month 1' FROM orders
       UNION SELECT DISTINCT 'month ' || month(o_orderdate), 'month ' || (month(o_orderdate) + 1) FROM orders),
w(name, depth) AS (SELECT 'africa', 0 UNION SELECT ch.dst, w.depth + 1 FROM w JOIN ch ON ch.src = w.name)
SELECT name, max(depth) AS phase FROM w GROUP BY name
""")
def _b5(t):
    """Cascade from a region to all downstream datasets, 16 hops deep, parents first."""
    o, month = t.orders, F.month("o_orderdate")
    name = lambda n: F.concat(F.lit("month "), n.cast("string"))
    head = o.select(F.lower("o_orderpriority").alias("src"), F.lit("month 1").alias("dst"))
    chain = o.select(name(month).alias("src"), name(month + 1).alias("dst"))
    return R.cascade(dag_edges(t).unionByName(head).unionByName(chain).distinct(), "africa", "all")


@REG.query("b6_restatement_progress", oracle="WITH " + TRACKER_SQL + """
, s AS (SELECT 'silver' AS layer, CAST(d AS DATE) AS slot FROM range(DATE '2001-06-01', DATE '2001-08-31', INTERVAL 1 DAY) r(d)
        UNION ALL SELECT 'bronze', CAST(d AS DATE) FROM range(DATE '2001-06-01', DATE '2001-08-31', INTERVAL 1 DAY) r(d)),
j AS (SELECT s.layer, s.slot, trk.status FROM s LEFT JOIN trk ON s.layer = trk.layer AND s.slot = trk.slot)
SELECT layer, count(*) AS slots, count(*) FILTER (WHERE status = 'success') AS done,
       count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'DQ_FAILED') AS dq_failed,
       count(*) FILTER (WHERE status IS NULL) AS pending,
       CASE WHEN count(*) FILTER (WHERE status IN ('failed', 'DQ_FAILED')) > 0 THEN 'partial_failure'
            WHEN count(*) FILTER (WHERE status = 'success') = count(*) THEN 'completed' ELSE 'running' END AS state
FROM j GROUP BY layer
""")
def _b6(t):
    """Restatement progress by layer over June-August 2001, newest marker of each slot."""
    cal = R.calendar(t.spark, "2001-06-01", "2001-08-30")
    slots = cal.select(F.lit("silver").alias("layer"), "slot").unionByName(cal.select(F.lit("bronze").alias("layer"), "slot"))
    return R.restatement_progress(slots, tracker(t))


@REG.query("b3_restate_and_record", oracle="""
WITH o AS (SELECT *, strftime(o_orderdate, '%Y_%m') AS m FROM orders),
s AS (SELECT 'rst-a' AS restatement_id, '1998_06' AS lo, '1998_06' AS hi, 'F' AS gone, 'silver/orders' AS dataset_id UNION ALL
      SELECT 'rst-b', '1998_01', '1998_03', '-', 'silver/orders'),
c AS (SELECT restatement_id, any_value(dataset_id) AS dataset_id, count(*) AS rows_before,
             count(*) FILTER (WHERE o_orderstatus <> gone) + count(*) FILTER (WHERE gone = '-' AND o_orderstatus = 'O') AS rows_after,
             count(DISTINCT m) AS partitions_affected
      FROM s JOIN o ON m BETWEEN lo AND hi GROUP BY restatement_id)
SELECT restatement_id, dataset_id, 'COMPLETED' AS status, rows_before, rows_after, rows_after - rows_before AS row_delta,
       CAST(partitions_affected AS INTEGER) AS partitions_affected, CASE restatement_id WHEN 'rst-a' THEN 1 ELSE 2 END AS trackers_deleted,
       3 AS records, true AS ended FROM c
UNION ALL SELECT 'rst-c', 'silver/orders', 'FAILED', NULL, NULL, NULL, NULL, NULL, 3, true
""")
def _b3r(t):
    """Three restatements of a monthly table (June 1998 loses rows, January to March get some twice, one fails
    while its rows are computed), read back from the registry that they leave."""
    spark, base = t.spark, scratch_path(t.spark, "b3r")
    o = t.orders.withColumn("m", F.date_format("o_orderdate", "yyyy_MM"))
    path, reg, trk = f"{base}/orders", f"{base}/registry", f"{base}/tracker"
    W.overwrite_slot(o, path, ["m"])
    for m in ("1998_01", "1998_02", "1998_06"):
        W.mark_done(spark, trk, "orders", "orders", m, 1)
    june = o.filter("m = '1998_06' AND o_orderstatus <> 'F'")
    spring = o.filter("m BETWEEN '1998_01' AND '1998_03'")
    spring = spring.unionByName(spring.filter("o_orderstatus = 'O'"))
    broken = o.filter("m = '1998_05'").withColumn("o_orderkey", F.raise_error(F.lit("source is gone")).cast("long"))
    runs = (("rst-a", june, "1998-06-01", "1998-06-30", ["1998_06"]), ("rst-b", spring, "1998-01-01", "1998-03-31", ["1998_01", "1998_02", "1998_03"]),
            ("rst-c", broken, "1998-05-01", "1998-05-31", None))
    for ident, rows, start, end, months in runs:
        slots = None if months is None else spark.createDataFrame([("orders", m) for m in months], "table string, partition string")
        try:
            R.restate_slots(spark, path, rows, ["m"], reg, "silver/orders", "orders_daily", "user@example.org", "late source rows", start, end,
                            ["silver"], trk, slots, ident)
        except Exception as error:
            if months is not None or "source is gone" not in str(error):
                raise
    records = R.read_registry(spark, reg)
    n = records.groupBy(F.col("restatement_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("records"))
    past = R.restatement_history(records, "silver/orders", 1, F.current_timestamp())
    return past.join(n, past.restatement_id == n.id).select(
        "restatement_id", "dataset_id", "status", "rows_before", "rows_after", "row_delta", "partitions_affected", "trackers_deleted",
        "records", (F.col("completed_at") >= F.col("triggered_at")).alias("ended"))


@REG.query("b2_clear_and_rerun", oracle="""
SELECT strftime(o_orderdate, '%Y_%m') AS "partition", CASE WHEN month(o_orderdate) = 2 THEN 'cleared' ELSE 'success' END AS status,
       CASE WHEN month(o_orderdate) = 3 THEN 3 WHEN month(o_orderdate) = 2 THEN 2 ELSE 1 END AS markers,
       CASE WHEN month(o_orderdate) = 2 THEN 0 ELSE count(*) END AS rows_written
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-05-01'
GROUP BY strftime(o_orderdate, '%Y_%m'), month(o_orderdate)
""")
def _b2b(t):
    """B2/K9: success, clear, success for one month, success and clear for another: the newest marker decides."""
    spark, trk = t.spark, scratch_path(t.spark, "b2b")
    o = t.orders.filter((F.year("o_orderdate") == 1998) & (F.month("o_orderdate") < 5))
    counts = {r["m"]: r["n"] for r in o.groupBy(F.date_format("o_orderdate", "yyyy_MM").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for m in sorted(counts):
        W.mark_done(spark, trk, "orders", "orders", m, counts[m])
    R.clear_markers(spark, trk, spark.createDataFrame([("orders", "1998_02"), ("orders", "1998_03")], "table string, partition string"))
    W.mark_done(spark, trk, "orders", "orders", "1998_03", counts["1998_03"])
    log = W.read_tracker(spark, trk)
    n = log.groupBy(F.col("partition").alias("p")).agg(F.count(F.lit(1)).cast("int").alias("markers"))
    newest = W.latest_marks(log)
    return newest.join(n, newest["partition"] == n.p).select("partition", "status", "markers", "rows_written")


@REG.query("b4_shared_request_ids", oracle="""
WITH a AS (SELECT lower(o_orderpriority) AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 2 AS e FROM orders WHERE o_orderstatus = 'P'),
r AS (SELECT lower(o_orderpriority) AS dataset_id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 1 AS e FROM orders
      WHERE o_orderdate < TIMESTAMP '1996-01-01')
SELECT dataset_id, 'batch' AS request_id, s AS date_range_start, e AS date_range_end,
       EXISTS (SELECT 1 FROM a WHERE k = dataset_id AND a.s <= r.e AND r.s <= a.e) AS conflict FROM r
""")
def _b4b(t):
    """Requests that all share one id: each range has its own answer."""
    day = F.to_date("o_orderdate")
    o = t.orders.withColumn("dataset_id", F.lower("o_orderpriority")).withColumn("restatement_id", F.lit("batch")) \
        .withColumn("date_range_start", day).withColumn("status", F.lit("running"))
    active = o.filter("o_orderstatus = 'P'").withColumn("date_range_end", F.date_add(day, 2))
    asked = o.filter(day < F.lit("1996-01-01").cast("date")).withColumn("date_range_end", F.date_add(day, 1))
    return R.conflicts(active, asked).select("dataset_id", "request_id", "date_range_start", "date_range_end", "conflict")
