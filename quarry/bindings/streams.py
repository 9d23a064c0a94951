"""Bindings for streaming operators: batch forms, and ``availableNow`` runs over staged files whose
output is read back (S14, K19, X1, X3, X7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.layout import LakeLayout
from ..streaming import streams as X
from . import Registry

REG = Registry()


@REG.query("x4_stream_bins", oracle="""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bin_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS bin_end,
       event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def _x4(t):
    """5-minute tumbling bins per event type (batch form of the watermarked stream)."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    b = X.stream_bins(e, "ts", "5 minutes", "10 minutes", [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")],
                      ["event_type"])
    return b.select(F.col("bin_start").cast("timestamp_ntz").alias("bin_start"), F.col("bin_end").cast("timestamp_ntz").alias("bin_end"),
                    "event_type", "n", "total")


@REG.query("x5_burn_rate_stream", oracle="""
WITH w AS (SELECT s AS window_start, l AS span, h.name FROM range(TIMESTAMP '2023-12-31 18:01:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 1 MINUTE) r(s),
           (VALUES (INTERVAL 1 HOUR, '1 hour'), (INTERVAL 6 HOUR, '6 hours')) h(l, name)),
j AS (SELECT name, window_start, span, count(*) FILTER (WHERE e.event_type <> 'error') AS good, count(*) AS total
      FROM w JOIN events e ON e.ts >= w.window_start AND e.ts < w.window_start + span GROUP BY ALL)
SELECT name AS "window", window_start, window_start + span AS window_end, good, total,
       round(good / total, 6) AS sli, round((1.0 - good / total) / 0.01, 6) AS burn_rate FROM j
""")
def _x5(t):
    """1-hour and 6-hour windows sliding every minute: SLI and burn rate."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return X.burn_rates(e, "ts", F.col("event_type") != "error", 0.99).select(
        "window", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "good", "total",
        F.round("sli", 6).alias("sli"), F.round("burn_rate", 6).alias("burn_rate"))


def staged_stream(t, name, files=4):
    """Events written as ``files`` files and read as a stream, one file per micro-batch."""
    base = scratch_path(t.spark, name)
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(files).write.parquet(f"{base}/landing")
    return X.stream_source(t.spark, f"{base}/landing", e.schema, max_files_per_trigger=1), base


@REG.query("x1_stream_ingest", oracle="SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, true AS stamped FROM events GROUP BY 1")
def _x1(t):
    """Staged files streamed into a partitioned folder, four micro-batches, with the
    pipeline's own checkpoint folder."""
    stream, base = staged_stream(t, "x1")
    X.stream_ingest(stream, f"{base}/table", LakeLayout(base).checkpoint("ingest events"), "availableNow", ["event_type"]).awaitTermination()
    return t.spark.read.parquet(f"{base}/table").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"), F.bool_and(F.col("_ingested_at").isNotNull()).alias("stamped"))


@REG.query("x3_batch_metrics", oracle="SELECT 4 AS batches, count(*) AS rows, true AS sized FROM events")
def _x3(t):
    """Batch id and row count recorded for every micro-batch."""
    stream, base = staged_stream(t, "x3")
    q = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True) \
        .foreachBatch(X.batch_metrics(f"{base}/metrics", every=1)).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{base}/metrics").agg(F.count_distinct("batch_id").alias("batches"), F.sum("rows").alias("rows"),
                                                       (F.min("bytes") > 0).alias("sized"))


@REG.query("x7_stream_upsert", oracle="""
SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, value, props, event_type, event_id)) IS NOT NULL AS found, 1 AS rows FROM events GROUP BY 1
""")
def _x7s(t):
    """Stream upsert keeps the newest row of every user; keys repeat inside the first batch
    and every delivery comes twice."""
    base = scratch_path(t.spark, "x7")
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    e.unionByName(e).repartition(3).write.parquet(f"{base}/landing")
    stream = X.stream_source(t.spark, f"{base}/landing", e.schema, max_files_per_trigger=1)
    X.stream_upsert(stream, f"{base}/table", f"{base}/checkpoint", ["user_id"], "ts", watermark="90 days",
                    dedup_keys=["event_id"], buckets=4).awaitTermination()
    return t.spark.read.parquet(f"{base}/table").groupBy("user_id").agg(
        F.max("ts").cast("timestamp_ntz").alias("ts"), F.bool_and(F.col("event_id").isNotNull()).alias("found"), F.count(F.lit(1)).alias("rows"))


@REG.query("x6_incremental", oracle="""
SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20') GROUP BY 1
""")
def _x6(t):
    """Rows above the target's high-water mark (target = events before Jan 20)."""
    target = t.events.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return X.incremental(t.events, target, "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@REG.query("x7_dedup_latest", oracle="""
SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1
""")
def _x7(t):
    """X7 batch form: newest row per key as upserted by each micro-batch."""
    return X.dedup_latest(t.events.select("user_id", "ts", "event_type"), ["user_id"], "ts")


@REG.query("x8_late_rows", oracle="""
SELECT event_type, count(*) AS n FROM events
WHERE CAST(ts AS DATE) = DATE '2024-01-10' AND NOT (hour(ts) BETWEEN 6 AND 17) GROUP BY 1
""")
def _x8(t):
    """Rows of a slot missing from the stream output (only 06-17 h arrived in time)."""
    e = t.events
    slot = F.to_date("ts") == F.lit("2024-01-10").cast("date")
    out = e.filter(slot & F.hour("ts").between(6, 17))
    return X.late_rows(out, e, ["event_id"], slot).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@REG.query("x3_observed_batches", oracle="SELECT 4 AS batches, count(*) AS rows, count(*) AS written, 2 AS recorded, true AS sized FROM events")
def _x3b(t):
    """Rows and bytes of micro-batches observed on the write (all batches, and every second one)."""
    stream, base = staged_stream(t, "x3b")
    for every in (1, 2):
        stream.writeStream.option("checkpointLocation", f"{base}/ck{every}").trigger(availableNow=True).foreachBatch(
            X.observed_sink(f"{base}/table{every}", f"{base}/metrics{every}", every)).start().awaitTermination()
    read = t.spark.read.schema(X.METRICS)
    seen = read.parquet(f"{base}/metrics1/batch=*").agg(
        F.count_distinct("batch_id").alias("batches"), F.sum("rows").alias("rows"), (F.min("bytes") > F.min("rows")).alias("sized"))
    some = read.parquet(f"{base}/metrics2/batch=*").agg(F.count(F.lit(1)).alias("recorded"))
    written = t.spark.read.parquet(f"{base}/table2").agg(F.count(F.lit(1)).alias("written"))
    return seen.join(some, F.lit(True)).join(written, F.lit(True))


@REG.query("x5_stream_running_totals", oracle="""
WITH m AS (SELECT max(date_trunc('minute', ts)) AS top FROM events),
b AS (SELECT date_trunc('minute', ts) AS b, count(*) FILTER (WHERE event_type <> 'error') AS good, count(*) AS total FROM events, m
      WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1),
w AS (SELECT s AS window_start FROM range(TIMESTAMP '2023-12-31 22:00:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 1 MINUTE) r(s)),
j AS (SELECT window_start, sum(good) AS good, sum(total) AS total FROM w JOIN b ON b.b >= window_start AND b.b < window_start + INTERVAL 1 HOUR
      WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(b) + INTERVAL 1 MINUTE FROM b) GROUP BY 1)
SELECT window_start, CAST(good AS BIGINT) AS good, CAST(total AS BIGINT) AS total, round(good / total, 6) AS sli FROM j
""")
def _x5s(t):
    """X5 on a stream: closed minute bins are kept, and each 1-hour window is computed once from running totals."""
    base = scratch_path(t.spark, "x5s")
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(4):  # four files in time order, one per micro-batch
        e.filter(F.floor((F.dayofmonth("ts") - 1) / 8) == k).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    stream = X.stream_source(t.spark, f"{base}/landing", e.schema, max_files_per_trigger=1)
    X.stream_burn_rates(stream, "ts", F.col("event_type") != "error", 0.99, f"{base}/out", f"{base}/ck",
                        (("1 hour", "1 minute"),)).awaitTermination()
    return t.spark.read.parquet(f"{base}/out/windows").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "good", "total", F.round("sli", 6).alias("sli"))
