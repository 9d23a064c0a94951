"""Bindings for sinks and write plans (K1-K18, F6, R18).  Writes go to fresh folders inside
the session's shared checkpoint area and are read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.quality_run import QualityTables, run_quality
from ..plans.slot_run import SlotSink, run_slot
from ..quality.rules import AcceptedValues, Expression, NotNull, UniqueKey, ValueRange
from ..session import cut_lineage, scratch_path
from ..sinks import clustering as Z
from ..sinks import tables as TB
from ..sinks import writers as W
from ..sinks.merge import apply_changes, change_feed, merge_upsert
from ..sinks.stamp import stamp_bronze, stamp_bronze_from_rows, stamp_datekey
from . import Registry

REG = Registry()


@REG.query("k3_stamp_bronze", oracle="""
SELECT year(o_orderdate) AS __year, month(o_orderdate) AS __month, day(o_orderdate) AS __day, hour(o_orderdate) AS __hour,
       count(*) AS n FROM orders GROUP BY ALL
""")
def _k3(t):
    """K3: bronze year / month / day / hour stamps from each row's time."""
    return stamp_bronze_from_rows(t.orders, "o_orderdate").groupBy("__year", "__month", "__day", "__hour").agg(
        F.count(F.lit(1)).alias("n"))


@REG.query("k3_stamp_bronze_slot", oracle="""
SELECT 2024 AS __year, 1 AS __month, 15 AS __day, hour(ts) AS __hour, count(*) AS n FROM events GROUP BY ALL
""")
def _k3b(t):
    """K3: run-slot stamps with the hour taken from the row time (hasHour)."""
    s = stamp_bronze(t.events, datetime(2024, 1, 15, 6), "ts", has_hour=True)
    return s.groupBy("__year", "__month", "__day", "__hour").agg(F.count(F.lit(1)).alias("n"))


@REG.query("k4_stamp_datekey", oracle="""
SELECT strftime(l_shipdate, '%d_%m_%Y_%H') AS __date, count(*) AS n FROM lineitem GROUP BY 1
""")
def _k4(t):
    """K4: DD_MM_YYYY_HH date key of every row."""
    return stamp_datekey(t.lineitem, time_col="l_shipdate").groupBy("__date").agg(F.count(F.lit(1)).alias("n"))


@REG.query("k11_merge_upsert", oracle="""
WITH tgt AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
src AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src) UNION ALL SELECT * FROM src
""")
def _k11(t):
    """Upsert by key (anti join + union); running it twice equals once."""
    o = t.orders
    tgt = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus", "o_totalprice")
    src = o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return merge_upsert(merge_upsert(tgt, src, ["o_orderkey"]), src, ["o_orderkey"])


@REG.query("k14_cluster_by", oracle="""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, 0 AS out_of_order FROM lineitem GROUP BY ALL
""")
def _k14(t):
    """Range clustering + sort inside partitions keeps every row, in order in each partition."""
    cols = ["l_returnflag", "l_linestatus", "l_shipdate"]
    c = stage_sorted(W.cluster_by(t.lineitem, cols, 8))
    before = F.lag(F.struct(*cols)).over(Window.partitionBy("__p").orderBy("__i"))
    c = c.withColumn("bad", F.coalesce(F.struct(*cols) < before, F.lit(False)))
    return c.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.count_if("bad").alias("out_of_order"))


@REG.query("k14_z_order", oracle="""
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, true AS first_prunes, true AS second_prunes FROM lineitem GROUP BY 1
""")
def _k14z(t):
    """Written along the Z curve of ship date and part: a range of either column skips most files; sorted by date and then
    part, a range of parts skips none."""
    spark, base, files = t.spark, scratch_path(t.spark, "k14z"), 16
    l = t.lineitem
    Z.z_order(l, ["l_shipdate", "l_partkey"], files).write.parquet(f"{base}/z")
    W.cluster_by(l, ["l_shipdate", "l_partkey"], files).write.parquet(f"{base}/sorted")
    parts = l.agg(F.percentile_approx("l_partkey", [0.0, 0.1])).first()[0]
    days = l.agg(F.expr("percentile_approx(l_shipdate, array(0.0, 0.1))")).first()[0]
    count = lambda place: Z.zone_map(spark.read.parquet(f"{base}/{place}"), ["l_shipdate", "l_partkey"]).agg(
        Z.files_touched("l_shipdate", *days).alias("by_day"), Z.files_touched("l_partkey", *parts).alias("by_part"),
        F.count(F.lit(1)).alias("files"))
    z, plain = count("z"), count("sorted").select(F.col("by_part").alias("plain_by_part"))
    verdict = z.join(plain, F.lit(True)).select(
        (F.col("by_day") <= F.col("files") / 2).alias("first_prunes"),
        ((F.col("by_part") <= F.col("files") / 2) & (F.col("by_part") < F.col("plain_by_part"))).alias("second_prunes"))
    rows = spark.read.parquet(f"{base}/z").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return rows.join(verdict, F.lit(True))


def stage_sorted(df):
    """The frame with each row's partition and place, checkpointed as it lies."""
    return cut_lineage(df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))


@REG.query("k15_expire", oracle="""
SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_id) AS ids FROM events
WHERE ts >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 14 DAY GROUP BY 1
""")
def _k15(t):
    """Retention on a daily table: days wholly expired go, the mixed day is rewritten."""
    path = scratch_path(t.spark, "k15")
    W.append(t.events.withColumn("day", F.to_date("ts")), path, ["day"])
    W.expire_table(t.spark, path, "ts", 14, "2024-01-31 12:00:00", ["day"])
    return t.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


CF_SQL = """
WITH a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p
           FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' UNION ALL SELECT NULL, 'N', max(o_orderpriority) FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS p
      FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT NULL, 'N', max(o_orderpriority) FROM orders),
j AS (SELECT a.o_orderkey AS ak, a.o_orderstatus AS ast, a.p AS ap, b.o_orderkey AS bk, b.o_orderstatus AS bst, b.p AS bp,
             a.o_orderstatus IS NOT NULL AS ina, b.o_orderstatus IS NOT NULL AS inb
      FROM a FULL OUTER JOIN b ON a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey)
"""


@REG.query("k17_change_feed", oracle=CF_SQL + """
SELECT bk AS o_orderkey, bst AS o_orderstatus, bp AS p, 'insert' AS _change_type FROM j WHERE NOT ina
UNION ALL SELECT ak, ast, ap, 'delete' FROM j WHERE NOT inb
UNION ALL SELECT ak, ast, ap, 'update_preimage' FROM j
  WHERE ina AND inb AND (ast IS DISTINCT FROM bst OR ap IS DISTINCT FROM bp)
UNION ALL SELECT bk, bst, bp, 'update_postimage' FROM j
  WHERE ina AND inb AND (ast IS DISTINCT FROM bst OR ap IS DISTINCT FROM bp)
""")
def _k17(t):
    """Change feed between two overlapping snapshots with NULL-safe comparison."""
    a, b = _snapshots(t)
    return change_feed(a, b, ["o_orderkey"])


def _snapshots(t):
    o = t.orders
    a = o.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    b = o.filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("p"))
    # an unchanged row with a NULL key in both
    none = o.agg(F.lit(None).cast("long").alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.max("o_orderpriority").alias("p"))
    return a.unionByName(none), b.unionByName(none)


@REG.query("k17_apply_changes", oracle=CF_SQL + "SELECT bk AS o_orderkey, bst AS o_orderstatus, bp AS p FROM j WHERE inb")
def _k17b(t):
    """K17 invariant: applying change_feed(a, b) to a gives b."""
    a, b = _snapshots(t)
    return apply_changes(a, change_feed(a, b, ["o_orderkey"]), ["o_orderkey"])


@REG.query("k1_overwrite_slot", oracle="""
SELECT strftime(o_orderdate, '%Y_%m') AS month_key, count(*) AS n,
       round(sum(CASE WHEN strftime(o_orderdate, '%Y_%m') = '1998_01' THEN o_totalprice + 1 ELSE o_totalprice END), 2) AS total
FROM orders GROUP BY 1
""")
def _k1(t):
    """K1/K2/K6: write monthly slots, replace one slot, register the table and read it back."""
    spark = t.spark
    path = scratch_path(spark, "k1")
    o = t.orders.withColumn("month_key", F.date_format("o_orderdate", "yyyy_MM"))
    W.overwrite_slot(o, path, ["month_key"])
    jan = o.filter(F.col("month_key") == "1998_01").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    W.overwrite_slot(jan, path, ["month_key"])
    name = W.register(spark, "silver", "k1_orders_" + path.rsplit("-", 1)[-1], path, partitioned=True)
    back = spark.table(name)
    return back.groupBy("month_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@REG.query("f6_run_slot", oracle="""
SELECT 'orders_daily' AS "table", strftime(CAST(o_orderdate AS DATE), '%d_%m_%Y_00') AS "partition", 'success' AS status,
       count(*) AS rows_written
FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1998-01-01', DATE '1998-01-02') GROUP BY 2
""")
def _f6(t):
    """Two slots written with markers; a rerun is skipped; an empty slot writes nothing."""
    spark = t.spark
    base = scratch_path(spark, "f6")
    sink = SlotSink(path=f"{base}/silver/orders_daily", layer="silver", table="orders_daily", tracker_path=f"{base}/_tracker")

    def source(s, slot):
        d = F.lit(slot.strftime("%Y-%m-%d")).cast("date")
        return t.orders.filter(F.to_date("o_orderdate") == d)

    for day in (datetime(1998, 1, 1), datetime(1998, 1, 2), datetime(1998, 1, 1), datetime(2005, 1, 1)):
        run_slot(spark, source, lambda df: df.withColumn("o_orderstatus", F.lower("o_orderstatus")), sink, day)
    return W.read_tracker(spark, sink.tracker_path).select("table", "partition", "status", "rows_written")


@REG.query("k12_merge_or_create", oracle="""
WITH a AS (SELECT o_orderkey, o_orderstatus, year(o_orderdate) AS y, 1 AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
d AS (SELECT o_orderkey, 'D' AS o_orderstatus, y, 2 AS v FROM a WHERE o_orderkey % 7 = 0),
s AS (SELECT o_orderkey, 'X' AS o_orderstatus, year(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 OR year(o_orderdate) = 1998 THEN 1 ELSE 0 END AS y, 3 AS v
      FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
m AS (SELECT o_orderkey, arg_max(o_orderstatus, v) AS o_orderstatus, arg_max(y, v) AS y FROM (FROM a UNION ALL FROM d UNION ALL FROM s) GROUP BY 1)
SELECT y, o_orderstatus, count(*) AS n FROM m GROUP BY ALL
""")
def _k12(t):
    """The first load settles repeated keys; the second merges the touched year partitions,
    moves keys to another year, and empties 1998."""
    spark, path = t.spark, scratch_path(t.spark, "k12")
    o, year = t.orders, F.year("o_orderdate")
    a = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus", year.alias("y"), F.lit(1).alias("v"))
    again = a.filter("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("D")).withColumn("v", F.lit(2))
    moved = F.when((F.col("o_orderkey") % 5 == 0) | (year == 1998), 1).otherwise(0)
    second = o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (year + moved).alias("y"), F.lit(3).alias("v"))
    W.merge_or_create(spark, a.unionByName(again), path, ["o_orderkey"], ["y"], order="v")
    W.merge_or_create(spark, second, path, ["o_orderkey"], ["y"], order="v")
    return spark.read.parquet(path).groupBy("y", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@REG.query("k13_compact", oracle="""
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, true AS fewer FROM lineitem GROUP BY 1
""")
def _k13(t):
    """Many small files per partition rewritten to fewer; every row stays."""
    spark, path = t.spark, scratch_path(t.spark, "k13")
    t.lineitem.repartition(16).write.partitionBy("l_returnflag").parquet(path)
    files = F.count_distinct(F.col("_metadata.file_path"))
    before = cut_lineage(spark.read.parquet(path).groupBy("l_returnflag").agg(files.alias("before")))
    W.compact(spark, path, ["l_returnflag"])
    after = spark.read.parquet(path).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), files.alias("after"))
    return after.join(before, "l_returnflag").select("l_returnflag", "n", "qty", (F.col("after") < F.col("before")).alias("fewer"))


#: partition values that folder names bend: number-like text, a quote, signs of paths, NULL
ODD_SQL = """CASE CAST(o_orderpriority AS VARCHAR) WHEN '1-URGENT' THEN '01' WHEN '2-HIGH' THEN '02' WHEN '3-MEDIUM' THEN 'it''s a=b/c%' WHEN '4-NOT SPECIFIED' THEN '1' END"""


def odd_partitions(t):
    o, p = t.orders, F.col("o_orderpriority")
    return o.select("o_orderkey", "o_orderdate", F.when(p == "1-URGENT", "01").when(p == "2-HIGH", "02").when(p == "3-MEDIUM", "it's a=b/c%")
                    .when(p == "4-NOT SPECIFIED", "1").alias("p"), F.lit(1).alias("v"))


@REG.query("k12_odd_partitions", oracle=f"""
WITH a AS (SELECT o_orderkey, {ODD_SQL} AS p, o_orderkey % 3 AS turn FROM orders)
SELECT CASE turn WHEN 0 THEN p WHEN 1 THEN '01' ELSE NULL END AS p, CASE turn WHEN 0 THEN 1 ELSE 2 END AS v, count(*) AS n, sum(o_orderkey) AS keys
FROM a GROUP BY ALL
""")
def _k12o(t):
    """K12 on a table partitioned by text such as '01', a quote and NULL: two thirds of the keys move, half of them to the
    NULL partition; none is lost or doubled."""
    spark, path = t.spark, scratch_path(t.spark, "k12o")
    a = odd_partitions(t).select("o_orderkey", "p", "v")
    turn = F.col("o_orderkey") % 3
    moved = a.filter(turn > 0).withColumn("p", F.when(turn == 1, "01")).withColumn("v", F.lit(2))
    W.merge_or_create(spark, a, path, ["o_orderkey"], ["p"])
    W.merge_or_create(spark, moved, path, ["o_orderkey"], ["p"])
    return TB.read_stored(spark, path).groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@REG.query("k1_odd_slots", oracle=f"""
SELECT p, count(*) AS n, sum(o_orderkey) AS keys, sum(CASE WHEN p = '01' THEN 2 ELSE 1 END) AS v FROM (SELECT *, {ODD_SQL} AS p FROM orders) GROUP BY 1
""")
def _k1o(t):
    """K1/K6: slots named by number-like text, a quote and NULL; one is replaced, all are registered by their own values and read by name."""
    spark, path = t.spark, scratch_path(t.spark, "k1o")
    a = odd_partitions(t)
    W.overwrite_slot(a, path, ["p"])
    W.overwrite_slot(a.filter("p = '01'").withColumn("v", F.lit(2)), path, ["p"])
    name = W.register(spark, "silver", "k1_odd_" + path.rsplit("-", 1)[-1], path, partitioned=True, slots=a.select("p"))
    return spark.table(name).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("v").alias("v"))


@REG.query("k13_compact_files", oracle=f"""
SELECT p, count(*) AS n, sum(o_orderkey) AS keys, true AS large_kept, true AS fewer FROM (SELECT *, {ODD_SQL} AS p FROM orders) GROUP BY 1
""")
def _k13f(t):
    """Only files under the target size are merged, by a plan of their sizes; a large file keeps its name."""
    spark, path = t.spark, scratch_path(t.spark, "k13f")
    a = odd_partitions(t)
    half = F.col("o_orderkey") % 2 == 0
    W.overwrite_slot(a.filter(half).coalesce(1), path, ["p"])
    file, length = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length")
    large = cut_lineage(TB.read_stored(spark, path, ["p"]).select("p", file, length).distinct())
    for k in range(4):
        W.append(a.filter(~half & (F.floor(F.col("o_orderkey") / 2) % 4 == k)).coalesce(1), path, ["p"])
    target = large.agg(F.min("length")).first()[0]
    before = cut_lineage(TB.read_stored(spark, path).groupBy("p").agg(F.count_distinct(F.col("_metadata.file_path")).alias("before")))
    TB.compact_files(spark, path, ["p"], target=target)
    rows = TB.read_stored(spark, path).select("p", "o_orderkey", file)
    kept, here = TB.same(rows, large.select("p", "file").withColumn("big", F.lit(True)), ["p", "file"])
    after = rows.join(kept, here, "left").groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("file").alias("after"), F.bool_or("big").alias("large_kept"))
    was, here = TB.same(after, before, ["p"])
    return after.join(was, here).select("p", "n", "keys", F.coalesce("large_kept", F.lit(False)).alias("large_kept"),
                                        (F.col("after") < F.col("before")).alias("fewer"))


@REG.query("k15_odd_partitions", oracle=f"""
SELECT p, count(*) AS n, sum(o_orderkey) AS keys FROM (SELECT *, {ODD_SQL} AS p FROM orders)
WHERE o_orderdate >= TIMESTAMP '1999-01-01' - INTERVAL 365 DAY AND coalesce(p, '-') <> '02' OR (p = '02' AND o_orderdate >= TIMESTAMP '1998-06-01') GROUP BY 1
""")
def _k15o(t):
    """K15 on number-like, quoted and NULL partitions: mixed ones are rewritten in place, nothing doubles."""
    spark, path = t.spark, scratch_path(t.spark, "k15o")
    W.append(odd_partitions(t).filter("coalesce(p, '-') <> '02' OR o_orderdate >= '1998-06-01'"), path, ["p"])
    W.expire_table(spark, path, "o_orderdate", 365, "1999-01-01 00:00:00", ["p"])
    return TB.read_stored(spark, path).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@REG.query("k15_version_window", oracle="""
SELECT CAST(substr(version, 2) AS INTEGER) AS version, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM (VALUES ('v2', 1994), ('v9', 1997), ('v10', 1998)) w(version, y) JOIN orders ON year(o_orderdate) >= y GROUP BY 1
""")
def _k15v(t):
    """Five published versions of an asset; the newest two stay, and the one still in use; the others' folders go."""
    spark, base = t.spark, scratch_path(t.spark, "k15v")
    published = []
    for version, year in (("v1", 1993), ("v2", 1994), ("v3", 1995), ("v9", 1997), ("v10", 1998)):
        t.orders.filter(F.year("o_orderdate") >= year).write.parquet(f"{base}/asset/version={version}")
        published.append((version, datetime(year, 1, 1)))
    catalogue = spark.createDataFrame(published, "version string, published_at timestamp")
    used = spark.createDataFrame([("v2",)], "version string")
    TB.retire_versions(spark, f"{base}/asset", keep=2, as_of="1999-01-01 00:00:00", support_days=180, in_use=used, versions=catalogue)
    return spark.read.parquet(f"{base}/asset").groupBy(F.substring("version", 2, 9).cast("int").alias("version")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@REG.query("k16_refresh_gold", oracle="""
SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1
""")
def _k16(t):
    """A partitioned gold table rebuilt whole; a segment that the new query no longer has goes."""
    spark, path = t.spark, scratch_path(t.spark, "k16")
    o, c = t.orders, t.customer
    q = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    W.refresh_gold(spark, q, path, ["c_mktsegment"])
    W.refresh_gold(spark, q.filter("c_mktsegment <> 'BUILDING'"), path, ["c_mktsegment"])
    return spark.read.parquet(path)


@REG.query("k18_archive_json", oracle="""
SELECT year(ts) AS year, month(ts) AS month, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY ALL
""")
def _k18(t):
    """Monthly gzip NDJSON archive read back."""
    spark = t.spark
    path = scratch_path(spark, "k18")
    W.archive_json(t.events, "ts", path)
    back = spark.read.json(path)
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@REG.query("r18_quality_run", oracle="""
WITH o AS (SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-03-01'),
a AS (SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS nn, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 450000) AS vr,
             count(*) FILTER (WHERE NOT o_orderstatus IN ('O', 'F')) AS av, count(*) - count(DISTINCT o_orderkey) AS dup FROM o)
SELECT 'keys' AS rule_name, CASE WHEN nn > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(nn AS BIGINT) AS affected_rows FROM a
UNION ALL SELECT 'total', CASE WHEN vr > 0 THEN 'FAIL' ELSE 'PASS' END, vr FROM a
UNION ALL SELECT 'status', CASE WHEN av > 0 THEN 'FAIL' ELSE 'PASS' END, av FROM a
UNION ALL SELECT 'pk', CASE WHEN dup > 0 THEN 'FAIL' ELSE 'PASS' END, dup FROM a
UNION ALL SELECT 'breaks_while_running', 'SKIPPED', CASE WHEN nn >= 0 THEN 0 END FROM a
""")
def _r18(t):
    """Quality run of one slot: metrics, rule and anomaly tables written, gate read;
    a rule that fails while running leaves its SKIPPED row."""
    spark = t.spark
    base = scratch_path(spark, "r18")
    day = t.orders.filter(F.to_date("o_orderdate") == F.lit("1998-03-01").cast("date"))
    rules = [NotNull("keys", column="o_orderkey"), ValueRange("total", "o_totalprice", min=1000, max=450000),
             AcceptedValues("status", "o_orderstatus", ["O", "F"], severity="warning"), UniqueKey("pk", ["o_orderkey"]), Expression("breaks_while_running", "cast(o_orderpriority AS int) > 0")]
    tables = QualityTables(base)
    run_quality(spark, day, "silver/orders", rules, tables, run_id="run-1998-03-01",
                run_timestamp=datetime(1998, 3, 1), fail_on_critical=False)
    return W.read_results(spark, tables.paths("silver/orders")["rules"]).select("rule_name", "status", "affected_rows")
