"""Bindings for scans and sources (S1-S4, S7-S11, S13, S15) and user surfaces.

Sources that need files in a given format are staged from the driver tables into fresh
folders of the shared checkpoint area, then scanned back with the operator under test.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..plans.quality_run import CustomMetric, check, track
from ..quality.rules import NotNull
from ..session import scratch_path
from ..sinks.stamp import stamp_bronze_from_rows, stamp_datekey
from ..sinks import writers as W
from ..sources import readers as S
from ..sources.layout import LakeLayout, render_path
from . import Registry

REG = Registry()


@REG.query("s1_parquet_scan", oracle="""
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity > 25 GROUP BY 1
""")
def _s1(t):
    """Parquet scan with reader options, pruned columns and a pushed filter."""
    df = S.read_source(t.spark, f"{t.sf_dir}/lineitem.parquet", "parquet", {"mergeSchema": "false"})
    df = S.source_filter(df, "l_quantity > 25")
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@REG.query("s2_csv_json_scan", oracle="""
SELECT o_orderstatus, count(*) AS n_csv, count(*) AS n_json FROM orders GROUP BY 1
""")
def _s2(t):
    """CSV and JSON scans chosen by format (staged from orders)."""
    spark = t.spark
    base = scratch_path(spark, "s2")
    o = t.orders.select("o_orderkey", "o_orderstatus")
    o.write.option("header", "true").csv(f"{base}/csv")
    o.write.json(f"{base}/json")
    c = S.read_source(spark, f"{base}/csv", "csv", {"header": "true"}).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_csv"))
    j = S.read_source(spark, f"{base}/json", "json").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_json"))
    return c.join(j, "o_orderstatus")


@REG.query("s3_render_path_glob", oracle="""
SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 AND month(o_orderdate) = 3
""")
def _s3(t):
    """Raw path template with {_year}/{_month} placeholders and a day glob."""
    spark = t.spark
    lay = LakeLayout(scratch_path(spark, "s3"))
    raw = lay.path("bronze", "orders_raw")
    W.append(stamp_bronze_from_rows(t.orders, "o_orderdate"), raw, ["__year", "__month"])
    p = render_path(raw + "/__year={_year}/__month={_month}/*.parquet", datetime(1998, 3, 1))
    return S.read_source(spark, p, "parquet", {"basePath": raw}).agg(F.count(F.lit(1)).alias("n"))


@REG.query("s4_read_registered", oracle="SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer")
def _s4(t):
    """Source registry row (type + config map) -> path -> scan."""
    spark = t.spark
    base = scratch_path(spark, "s4")
    t.customer.write.parquet(f"{base}/landing/customers")
    reg = spark.createDataFrame([("crm", "local", {"root": base, "base_path": "landing", "format": "parquet"})],
                                "name string, source_type string, config map<string,string>")
    df = S.read_registered(spark, reg, "crm", "customers")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"))


@REG.query("s6_asset_path", oracle="SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _s6(t):
    """An asset written under its versioned path and read back through the template."""
    lay = LakeLayout(scratch_path(t.spark, "s6"))
    for version, keep in ((1, "n_nationkey < 0"), (2, "n_nationkey >= 0")):
        path = lay.asset("gold", "geo", "nation", "internal", "all", "daily", version, "regions")
        n = t.nation.filter(keep).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        n.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("nations")).write.parquet(path)
    return t.spark.read.parquet(lay.asset("gold", "geo", "nation", "internal", "all", "daily", 2, "regions"))


@REG.query("s8_read_slot", oracle="""
SELECT 'bronze' AS layer, count(*) AS n, 1 AS partitions FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'
UNION ALL SELECT 'silver', count(*), 1 FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'
""")
def _s8(t):
    """Slot filter on partition columns of bronze (y/m/d) and silver (__date) tables; only
    the slot's partition is read."""
    spark, base = t.spark, scratch_path(t.spark, "s8")
    W.append(stamp_bronze_from_rows(t.events, "ts"), f"{base}/b", ["__year", "__month", "__day"])
    W.append(stamp_datekey(t.events.withColumn("__at", F.date_trunc("day", "ts")), time_col="__at"), f"{base}/s", ["__date"])
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    parts = []
    for layer in ("bronze", "silver"):
        rows = S.read_slot(spark.read.parquet(f"{base}/{layer[0]}"), layer, datetime(2024, 1, 10))
        parts.append(rows.agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("n"), F.count_distinct(folder).alias("partitions")))
    return parts[0].unionByName(parts[1])


@REG.query("s11_ingest_csv", oracle="""
SELECT o_orderstatus AS Status, count(*) AS n, count(DISTINCT _ingestion_date) AS dates FROM
  (SELECT o_orderstatus, '2024-02-01' AS _ingestion_date FROM orders) GROUP BY 1
""")
def _s11(t):
    """Semicolon CSV with header and BOM, all strings, plus ingest columns."""
    spark = t.spark
    base = scratch_path(spark, "s11")
    o = t.orders.select(F.col("o_orderkey").alias("﻿InvoiceID"), F.col("o_orderstatus").alias("Status"))
    o.write.option("header", "true").option("sep", ";").csv(base)
    df = S.ingest_csv(spark, base, ";", "invoices", "2024-02-01")
    return df.groupBy("Status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_ingestion_date").alias("dates"))


@REG.query("s13_latest_version", oracle="""
SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1
""")
def _s13(t):
    """Versioned asset folders v1, v2, v3; only the newest version is read."""
    spark = t.spark
    base = scratch_path(spark, "s13")
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    for v, since in ((1, "1995-01-01"), (2, "1996-01-01"), (3, "1997-01-01")):
        o.filter(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz")).write.parquet(f"{base}/version=v{v}")
    df = S.latest_version(spark.read.parquet(base), "version")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@REG.query("s15_ingest_manifest", oracle="""
SELECT 'whole' AS folder, count(*) AS rows, true AS sized, true AS same FROM orders
UNION ALL SELECT 'turned', count(*), true, true FROM orders
UNION ALL SELECT 'doubled', 2 * count(*) FILTER (WHERE o_orderstatus = 'P') + count(*), true, false FROM orders
""")
def _s15(t):
    """Per-file size, rows and checksum: the order of rows does not matter, repeats do."""
    spark, o = t.spark, t.orders
    twice = o.filter("o_orderstatus = 'P'")
    out = None
    for name, df in (("whole", o), ("turned", o.sort(F.col("o_orderkey").desc())), ("doubled", o.unionAll(twice).unionAll(twice))):
        base = scratch_path(spark, f"s15-{name}")
        df.repartition(4).write.parquet(base)
        m = S.ingest_manifest(spark.read.parquet(base)).agg(
            F.sum("rows").alias("rows"), (F.min("file_size") > 0).alias("sized"), F.sum("checksum").alias("sum"))
        m = m.select(F.lit(name).alias("folder"), "rows", "sized", "sum")
        out = m if out is None else out.unionByName(m)
    first = out.filter("folder = 'whole'").select(F.col("sum").alias("first"))
    return out.crossJoin(F.broadcast(first)).select("folder", "rows", "sized", (F.col("sum") == F.col("first")).alias("same"))


@REG.query("s10_assert_not_empty", oracle="SELECT count(*) AS n FROM region")
def _s10(t):
    """Empty-source check passes for a non-empty table."""
    return S.assert_not_empty(t.region).agg(F.count(F.lit(1)).alias("n"))


@REG.query("f3_custom_metric", oracle="""
SELECT 'avg_price:' || o_orderstatus AS rule_name, CASE WHEN avg(o_totalprice) < 200000 THEN 'PASS' ELSE 'FAIL' END AS status,
       CAST(round(avg(o_totalprice), 2) AS VARCHAR) AS actual_value FROM orders GROUP BY o_orderstatus
""")
def _f3(t):
    """a custom metric function (one row per status) turned into rule results."""
    def fn(df):
        return df.groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("value")).select(
            F.col("o_orderstatus").alias("metric_name"), "value", (F.col("value") < 200000).alias("passed"),
            F.lit("mean order price").alias("message"))
    r = check(t.orders, "silver/orders", [CustomMetric("avg_price", fn, "critical")])
    return r.select("rule_name", "status", "actual_value")


@REG.query("f4_track_decorator", oracle="""
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
""")
def _f4(t):
    """decorated transform checked on return (not_null passes), frame returned unchanged."""
    @track("silver/orders_finished", rules=[NotNull("key", column="o_orderkey")])
    def finished(df):
        return df.filter(F.col("o_orderstatus") == "F")

    out = finished(t.orders)
    assert finished.last_report["overall_status"] == "PASS"
    return out.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
