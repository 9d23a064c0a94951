"""Bindings for projections, joins, windows, sorts and set operations (P, J, W, T, U4, C3)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins as J
from ..operators import sorts as S
from ..operators import transforms as P
from ..operators import windows as W
from ..operators.setops import next_version, schema_diff
from ..quality.history import slot_metrics, spc
from . import Registry
from .derived import CATALOGUE_SQL, PIPELINES_SQL, RUNS_SQL, catalogue, pipelines, runs
from .quality import EXPECTED_ORDERS, SCHEMA_DIFF_ORACLE

REG = Registry()
W_ = "WITH p AS (" + PIPELINES_SQL + "), r AS (" + RUNS_SQL + "), c AS (" + CATALOGUE_SQL + ")\n"


# --- P1-P5, P9-P11, P13 -------------------------------------------------------------------
@REG.query("p1_drop_null", oracle="""
SELECT count(*) AS n, sum(l_orderkey) AS keys FROM (SELECT l_orderkey, nullif(l_returnflag, 'N') AS f FROM lineitem) WHERE f IS NOT NULL
""")
def _p1(t):
    """Drop rows with NULL in a column."""
    l = t.lineitem.select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("f"))
    return P.drop_null(l, ["f"]).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@REG.query("p2_p3_cast_parse", oracle="""
SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS total, CAST(o_orderdate AS DATE) AS order_day,
       strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')::DATE AS parsed_day,
       CAST(o_custkey AS INTEGER) AS cust
FROM orders
""")
def _p2(t):
    """Cast to decimal(18,2) and int, derive a date, parse dd/MM/yyyy text."""
    o = t.orders.select("o_orderkey", F.round("o_totalprice", 2).alias("total"), "o_orderdate",
                        F.date_format("o_orderdate", "dd/MM/yyyy").alias("txt"), F.col("o_custkey").alias("cust"))
    o = P.cast_cols(o, {"total": "decimal(18,2)", "cust": "int"})
    o = P.derive_date(o, "o_orderdate", "order_day")
    o = P.parse_cols(o, {"txt": ("date", "dd/MM/yyyy")})
    return P.drop_cols(o.withColumnRenamed("txt", "parsed_day"), ["o_orderdate"])


@REG.query("p4_p5_stamp_drop", oracle="SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, 5 AS cols FROM orders")
def _p4(t):
    """Processing-time column (one value per query) and dropped columns."""
    o = P.drop_cols(P.stamp_processed(t.orders, "_processed_at"), ["o_orderpriority", "o_comment_missing"])
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"),
                 F.lit(len(o.columns) - 1).alias("cols"))


@REG.query("p9_recent", oracle="""
SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY GROUP BY 1
""")
def _p9(t):
    """Rows of the last 7 days before a fixed as-of."""
    return P.recent(t.events, "ts", 7, "2024-01-30 00:00:00").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@REG.query("p10_match_regex", oracle="""
SELECT source, count(*) AS n FROM documents WHERE regexp_matches(source, '^src1[0-9]$') GROUP BY 1
""")
def _p10(t):
    """P10: regex filter."""
    return P.match_regex(t.documents, "source", "^src1[0-9]$").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@REG.query("p11_model", oracle="""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts,
       CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS order_total_usd, lower(trim(o_orderstatus)) AS status
FROM orders WHERE o_orderstatus <> 'P'
""")
def _p11(t):
    """Status filter and projection to the modelled columns."""
    return P.model(t.orders, {"order_id": F.col("o_orderkey").cast("string"), "customer_id": "o_custkey",
                              "order_ts": "o_orderdate",
                              "order_total_usd": F.round("o_totalprice", 2).cast("decimal(18,2)"),
                              "status": F.lower(F.trim("o_orderstatus"))}, F.col("o_orderstatus") != "P")


@REG.query("p13_dev_sample", oracle="""
SELECT event_id, ts, user_id, event_type, value, props FROM events
WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY AND substr(md5(CAST(event_id AS VARCHAR)), 1, 8) < '1999999a'
""")
def _p13(t):
    """Last 30 days of events, a 10% sample by a hash of the key."""
    return P.dev_sample(t.events, "ts", 30, 0.1, "event_id", "2024-01-31 00:00:00")


@REG.query("p8_search_tables", oracle=W_ + """
SELECT name, schema, layer FROM c WHERE contains(lower(name), 'tion_1') OR contains(lower(schema), 'tion_1') ORDER BY name, schema LIMIT 20
""")
def _p8(t):
    """Case-insensitive search over catalogue names, first 20."""
    return P.search_tables(catalogue(t), "TION_1", 20)


# --- J1-J4, J7-J12 ------------------------------------------------------------------------
def _event_metrics(t):
    return slot_metrics(t.events, F.to_date("ts").cast("timestamp_ntz"), ["event_type"], "bronze/events")


@REG.query("j1_metric_trend", oracle="""
WITH g AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS run_timestamp, count(*) AS rows FROM events GROUP BY 1),
m AS (SELECT strftime(run_timestamp, '%Y-%m-%dT%H:%M:%S') AS run_id, run_timestamp, CAST(rows AS DOUBLE) AS value FROM g),
s AS (SELECT *, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd, count(value) OVER w AS pts
      FROM (SELECT *, epoch_us(run_timestamp) AS t FROM m)
      WINDOW w AS (ORDER BY t RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING)),
a AS (SELECT run_id, round((value - mu) / sd, 6) AS z_score FROM s WHERE pts >= 7 AND sd > 0)
SELECT m.run_id, m.value, a.z_score FROM m LEFT JOIN a ON m.run_id = a.run_id ORDER BY m.run_timestamp DESC, m.run_id DESC LIMIT 30
""")
def _j1(t):
    """Metrics LEFT JOIN anomalies on run id + constant metric, newest 30."""
    m = _event_metrics(t)
    j = J.metric_trend(m, spc(m), "rows_written", 30)
    return j.select("run_id", "value", F.round("z_score", 6).alias("z_score"))


@REG.query("j2_flag_has_dq", oracle=W_ + """
SELECT c.name, c.layer, c.name IN (SELECT DISTINCT lower(n_name) FROM nation WHERE n_regionkey <= 2) AS has_dq FROM c
""")
def _j2(t):
    """Catalogue flagged with has-DQ (datasets that have a summary)."""
    summaries = t.nation.filter("n_regionkey <= 2").select(F.lower("n_name").alias("name"))
    return J.flag_has_dq(catalogue(t), summaries, "name").select("name", "layer", "has_dq")


@REG.query("j3_live_tables", oracle=W_ + """
SELECT name, schema FROM c WHERE (schema, name) IN (SELECT ('silver', lower(n_name)) FROM nation JOIN customer ON c_nationkey = n_nationkey)
""")
def _j3(t):
    """Catalogue entries that have live columns (left semi join)."""
    live = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lit("silver").alias("schema"), F.lower("n_name").alias("name"))
    return J.live_tables(catalogue(t), live).select("name", "schema")


@REG.query("j4_active_dags", oracle=W_ + "SELECT dag_id, owner_alias FROM p WHERE deleted_at IS NULL")
def _j4(t):
    """Pipelines minus soft-deleted deployments (left anti join)."""
    p = pipelines(t)
    return J.active_pipelines(p.select("dag_id", "owner_alias"), p.select("dag_id", "deleted_at"))


@REG.query("j8_overlapping_ranges", oracle="""
WITH q AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS s,
                  CAST(o_orderdate AS DATE) + CAST(floor(o_totalprice / 5000) AS INTEGER) AS e, o_orderstatus FROM orders),
x AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
      FROM q WHERE o_orderstatus = 'F'),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e) AS grp FROM x),
m AS (SELECT o_custkey, grp, min(s) AS busy_from, max(e) AS busy_to FROM g GROUP BY ALL)
SELECT q.o_custkey, q.o_orderkey AS request_id, q.s, q.e, count(m.grp) > 0 AS conflict, count(m.grp) AS n_ranges,
       min(busy_from) AS busy_from, min(busy_to) AS busy_to
FROM q LEFT JOIN m ON q.o_custkey = m.o_custkey AND q.s <= busy_to AND busy_from <= q.e
WHERE q.o_orderstatus = 'O' GROUP BY ALL
""")
def _j8(t):
    """Each range with whether it overlaps a range of the same key (merged, bucketed)."""
    q = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("s"),
                        F.date_add(F.to_date("o_orderdate"), F.floor(F.col("o_totalprice") / 5000).cast("int")).alias("e"),
                        "o_orderstatus")
    req = q.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("request_id"), "s", "e")
    return J.overlapping(req, q.filter("o_orderstatus = 'F'"), "o_custkey", "s", "e")


@REG.query("j7_upsert_join", oracle="""
WITH tgt AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
src AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice
FROM tgt t FULL OUTER JOIN src s ON t.o_orderkey = s.o_orderkey
""")
def _j7(t):
    """Upsert by full outer join (update all / insert all)."""
    o = t.orders
    tgt = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus", "o_totalprice")
    src = o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return J.upsert_join(tgt, src, ["o_orderkey"])


@REG.query("j9_resolve_nodes", oracle=W_ + """
, n AS (SELECT DISTINCT lower(o_orderpriority) AS name FROM orders UNION SELECT DISTINCT lower(n_name) FROM nation)
SELECT n.name, CASE WHEN c.name IS NOT NULL THEN c.schema || '/' || c.name ELSE 'external:' || n.name END AS guid,
       CASE WHEN c.name IS NOT NULL THEN upper(substr(c.layer, 1, 1)) || substr(c.layer, 2) || ' Delta Table' ELSE 'External' END AS type,
       coalesce(c.layer, 'external') AS layer
FROM n LEFT JOIN c ON n.name = c.name
""")
def _j9(t):
    """Lineage nodes resolved to catalogue entries, else external."""
    nodes = t.orders.select(F.lower("o_orderpriority").alias("name")).union(t.nation.select(F.lower("n_name"))).distinct()
    return J.resolve_nodes(nodes, catalogue(t)).select("name", "guid", "type", "layer")


@REG.query("j10_serve_join", oracle="""
SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def _j10(t):
    """Cross-domain multi-way join for serving (strategy left to Catalyst/AQE)."""
    l, o, c, n, r = t.lineitem, t.orders, t.customer, t.nation, t.region
    j = J.serve_join(l, o, l.l_orderkey == o.o_orderkey)
    j = J.serve_join(j, c, j.o_custkey == c.c_custkey)
    j = J.serve_join(j, n, j.c_nationkey == n.n_nationkey)
    j = J.serve_join(j, r, j.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
                                             F.count(F.lit(1)).alias("lines"))


@REG.query("j11_join_small", oracle="""
SELECT s_name, count(*) AS lines, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
""")
def _j11(t):
    """Join with a side expected small; its bytes decide the strategy at run time."""
    l, s = t.lineitem, t.supplier
    j = J.join_small(l, s, l.l_suppkey == s.s_suppkey)
    return j.groupBy("s_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@REG.query("j12_with_last_run", oracle=W_ + """
, l AS (SELECT dag_id, count(*) AS run_count, arg_max(dag_run_id, (start_date, dag_run_id)) AS last_dag_run_id,
               arg_max(state, (start_date, dag_run_id)) AS last_state, max(start_date) AS last_start_date FROM r GROUP BY dag_id)
SELECT p.dag_id, l.run_count, l.last_dag_run_id, l.last_state, l.last_start_date FROM p LEFT JOIN l ON p.dag_id = l.dag_id
""")
def _j12(t):
    """Newest run joined to each pipeline in one pass (max_by per pipeline)."""
    j = J.with_last_run(pipelines(t).select("dag_id"), runs(t).select("dag_id", "dag_run_id", "state", "start_date"))
    return j.select("dag_id", "run_count", "last_dag_run_id", "last_state", "last_start_date")


# --- W3, W4, W6 ---------------------------------------------------------------------------
@REG.query("w3_latest_per", oracle="""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type
FROM events GROUP BY user_id
""")
def _w3(t):
    """Newest event per user (max_by with full tie-break)."""
    return W.latest_per(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"])


@REG.query("w4_runs_by_day", oracle=W_ + """
, k AS (SELECT *, CAST(coalesce(logical_date, start_date) AS DATE) AS day,
               row_number() OVER (PARTITION BY CAST(coalesce(logical_date, start_date) AS DATE)
                                  ORDER BY coalesce(start_date, logical_date) DESC, dag_run_id DESC) AS rank_in_day FROM r)
SELECT dag_run_id, day, rank_in_day,
       arg_max(state, (coalesce(start_date, logical_date), dag_run_id)) OVER (PARTITION BY day) AS day_state,
       count(*) OVER (PARTITION BY day) AS runs_in_day
FROM k
""")
def _w4(t):
    """Runs grouped by day, newest first inside the day, day state of the newest run."""
    return W.runs_by_day(runs(t)).select("dag_run_id", "day", "rank_in_day", "day_state", "runs_in_day")


@REG.query("w4_runs_without_day", oracle=W_ + """
, n AS (SELECT dag_run_id, state, CASE WHEN state = 'queued' THEN NULL ELSE start_date END AS start_date,
               CASE WHEN state = 'queued' THEN NULL ELSE logical_date END AS logical_date FROM r),
k AS (SELECT *, CAST(coalesce(logical_date, start_date) AS DATE) AS day FROM n)
SELECT dag_run_id, day, row_number() OVER (PARTITION BY day ORDER BY start_date DESC NULLS LAST, dag_run_id DESC) AS rank_in_day,
       count(*) OVER (PARTITION BY day) AS runs_in_day FROM k
""")
def _w4n(t):
    """Queued runs have no time yet: they stay, as a group of their own."""
    r = runs(t)
    timed = lambda c: F.when(F.col("state") != "queued", F.col(c)).alias(c)
    r = r.select("dag_run_id", "state", timed("start_date"), timed("logical_date"))
    return W.runs_by_day(r).select("dag_run_id", "day", "rank_in_day", "runs_in_day")


@REG.query("w6_dedup", oracle="""
SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS l_partkey,
       max(l_shipdate) AS l_shipdate
FROM lineitem GROUP BY l_orderkey, l_linenumber
""")
def _w6(t):
    """One row per key, newest by ship date (deterministic tie-break on all columns)."""
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    d = W.dedup(l, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


# --- T1-T5 --------------------------------------------------------------------------------
@REG.query("t1_newest", oracle="SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _t1(t):
    """Newest 50 rows."""
    return S.newest(t.events.select("event_id", "ts", "event_type"), "ts", 50, "event_id")


@REG.query("t2_top_k", oracle="""
SELECT l_suppkey, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1 ORDER BY cost DESC, l_suppkey LIMIT 8
""")
def _t2(t):
    """Top 8 suppliers by cost."""
    g = t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("cost"))
    return S.top_k(g, "cost", 8, "l_suppkey")


@REG.query("t3_recent_dags", oracle=W_ + """
, l AS (SELECT dag_id, max(start_date) AS last_run_at FROM r GROUP BY 1)
SELECT p.dag_id, l.last_run_at FROM p LEFT JOIN l ON p.dag_id = l.dag_id ORDER BY l.last_run_at DESC NULLS LAST, p.dag_id LIMIT 14
""")
def _t3(t):
    """Recent pipelines, never-run last, name tie-break, 14 rows."""
    last = runs(t).groupBy("dag_id").agg(F.max("start_date").alias("last_run_at"))
    cards = pipelines(t).select("dag_id").join(last, "dag_id", "left")
    return S.recent_pipelines(cards, 14)


@REG.query("t4_sorted_tables", oracle=W_ + "SELECT layer, name FROM c ORDER BY layer, name")
def _t4(t):
    """T4: tables by (layer, name)."""
    return S.sorted_tables(catalogue(t)).select("layer", "name")


@REG.query("t5_newest_run_results", oracle="""
WITH d AS (SELECT o_orderpriority AS dataset, strftime(o_orderdate, '%Y-%m') AS run_id, o_orderdate AS run_timestamp,
                  o_orderkey, o_orderstatus AS status FROM orders),
l AS (SELECT dataset, arg_max(run_id, (run_timestamp, run_id)) AS run_id FROM d GROUP BY dataset)
SELECT d.dataset, d.run_id, d.o_orderkey, d.status FROM d JOIN l ON d.dataset = l.dataset AND d.run_id = l.run_id
""")
def _t5(t):
    """T5: all rows of the newest run per dataset."""
    d = t.orders.select(F.col("o_orderpriority").alias("dataset"), F.date_format("o_orderdate", "yyyy-MM").alias("run_id"),
                        F.col("o_orderdate").alias("run_timestamp"), "o_orderkey", F.col("o_orderstatus").alias("status"),
                        F.col("o_orderkey").cast("string").alias("rule_name"))
    return S.newest_run_results(d).select("dataset", "run_id", "o_orderkey", "status")


# --- U4 / C3 ------------------------------------------------------------------------------
@REG.query("u4_schema_diff", oracle=SCHEMA_DIFF_ORACLE)
def _u4(t):
    """U4: column-level diff between a contract schema and the orders scan schema."""
    return schema_diff(t.spark, EXPECTED_ORDERS, t.orders.schema)


@REG.query("c3_next_version", oracle=f"""
WITH d AS ({SCHEMA_DIFF_ORACLE})
SELECT count(*) AS changes,
       count(*) FILTER (WHERE change IN ('dropped', 'retyped', 'renamed') OR (change = 'nullability' AND old_nullable AND NOT new_nullable)) AS breaking_changes,
       count(*) FILTER (WHERE change IN ('dropped', 'retyped', 'renamed') OR (change = 'nullability' AND old_nullable AND NOT new_nullable)) > 0 AS breaking,
       CASE WHEN count(*) FILTER (WHERE change IN ('dropped', 'retyped', 'renamed') OR (change = 'nullability' AND old_nullable AND NOT new_nullable)) > 0 THEN 4 ELSE 3 END AS version
FROM d
""")
def _c3(t):
    """Breaking schema change -> next dataset version."""
    return next_version(schema_diff(t.spark, EXPECTED_ORDERS, t.orders.schema), 3)
