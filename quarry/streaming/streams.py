"""Structured Streaming operators.

Transformations (``stream_bins``, ``burn_rate_stream``, ``incremental``, ``late_rows``) are plain
DataFrame functions, so the same code runs on a stream or on a batch frame; tests check that an
``availableNow`` run equals the batch result.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_source(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, options: dict | None = None) -> DataFrame:
    """Stream a landing folder with an explicit schema (no inference on streams)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load(path)


def _trigger(w, trigger):
    if trigger in (None, "availableNow"):
        return w.trigger(availableNow=True)
    if trigger == "once":
        return w.trigger(once=True)
    return w.trigger(processingTime=trigger)


def stream_sink(df: DataFrame, path: str, checkpoint: str, trigger: str | None = "30 seconds",
                partition_cols=None, fmt: str = "parquet", output_mode: str = "append") -> StreamingQuery:
    """File sink with a checkpoint (exactly-once per micro-batch)."""
    w = df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    return _trigger(w, trigger).start(path)


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = "30 seconds",
                  partition_cols=None) -> StreamingQuery:
    """Micro-batch ingest into a table folder (30 s trigger by default)."""
    out = stream.withColumn("_ingested_at", F.current_timestamp())
    return stream_sink(out, path, checkpoint, trigger, partition_cols)


METRICS = "query_id string, batch_id long, rows long, bytes long, recorded_at timestamp"


def observed_sink(path: str, metrics_path: str, every: int = 10, partition_cols=None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each micro-batch to ``path`` and records the
    metrics of every ``every``-th one in ``metrics_path``.

    Rows and bytes (the JSON form of the rows) are observed by the write itself, so a batch is read once.  Each
    batch has its own folder, which a replay overwrites, so rows and records are there once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, out, record = batch.sparkSession, batch, batch_id % every == 0
        obs = Observation(f"batch_{batch_id}")
        if record:
            size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch.columns])))
            out = batch.observe(obs, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
        w = out.write.mode("overwrite")
        (w.partitionBy(*partition_cols) if partition_cols else w).parquet(f"{path}/batch_id={batch_id}")
        if record:
            seen, query = obs.get, spark.sparkContext.getLocalProperty("sql.streaming.queryId")
            row = spark.createDataFrame([(query, int(batch_id), seen["rows"], seen["bytes"], None)], METRICS)
            row.withColumn("recorded_at", F.current_timestamp()).coalesce(1).write.mode("overwrite") \
                .parquet(f"{metrics_path}/batch={batch_id}")

    return write


def batch_metrics(metrics_path: str, every: int = 10) -> Callable[[DataFrame, int], None]:
    """X3 without a sink of its own: a ``foreachBatch`` function that reads every ``every``-th batch for its row
    count and bytes.  ``observed_sink`` observes them on the write instead."""

    def record(batch: DataFrame, batch_id: int) -> None:
        if batch_id % every != 0:
            return
        spark = batch.sparkSession
        n = batch.agg(F.count(F.lit(1)).alias("rows"),
                      F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch.columns])))).alias("bytes"))
        n.select(F.lit(batch_id).cast("long").alias("batch_id"), "rows", F.coalesce("bytes", F.lit(0)).alias("bytes"),
                 F.current_timestamp().alias("recorded_at")).write.mode("append").parquet(metrics_path)

    return record


def stream_bins(stream: DataFrame, ts: str, bin_: str, watermark: str | None, aggs: list[Column],
                keys=()) -> DataFrame:
    """Tumbling bins (5 min / 10 min / 1 h / 24 h) with a watermark for late data."""
    s = stream.withWatermark(ts, watermark) if watermark and stream.isStreaming else stream
    g = s.groupBy(F.window(F.col(ts), bin_).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), *keys,
                    *[c for c in g.columns if c not in ("w", *keys)])


# Burn-rate windows, evaluated each minute.
BURN_WINDOWS = (("1 hour", "1 minute"), ("6 hours", "1 minute"))


def burn_rate_stream(stream: DataFrame, ts: str, good: Column, target: float, window: str = "1 hour",
                     slide: str = "1 minute", watermark: str | None = "10 minutes") -> DataFrame:
    """Sliding window (e.g. 1 h every minute): SLI and burn rate = (1 - SLI) / (1 - target).

    A batch frame goes through ``burn_rates``.  A stream is a chain of two windows under one
    watermark: rows are counted once per ``slide``, and only those bin rows are copied into the
    windows that contain them; ``stream_burn_rates`` does without the copies.
    """
    w_s, s_s = _spans(window, slide)
    if not stream.isStreaming:
        return burn_rates(stream, ts, good, target, ((window, slide),)).drop("window")
    s = stream.withWatermark(ts, watermark) if watermark else stream
    b = s.groupBy(F.window(F.col(ts), slide).alias("b")).agg(*_counted(good))
    g = b.groupBy(F.window(F.window_time("b"), window, slide).alias("w")).agg(F.sum("good").alias("good"), F.sum("total").alias("total"))
    return _rates(g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "good", "total"), target)


def _counted(good: Column) -> list[Column]:
    return [F.count_if(good).alias("good"), F.count(F.lit(1)).alias("total")]


def _rates(totals: DataFrame, target: float) -> DataFrame:
    sli = F.col("good") / F.col("total")
    return totals.withColumns({"sli": sli, "burn_rate": (F.lit(1.0) - sli) / F.lit(1.0 - float(target))})


def _spans(window: str, slide: str) -> tuple[int, int]:
    w_s, s_s = _seconds(window), _seconds(slide)
    if w_s % s_s:
        raise ValueError("window must be a multiple of slide")
    return w_s, s_s


def burn_rates(df: DataFrame, ts: str, good: Column, target: float, windows=BURN_WINDOWS) -> DataFrame:
    """X5 for several windows over one scan: rows are counted per slide bin, and each window's
    counts are a difference of running totals of the bins (``sliding_totals``)."""
    slides = {slide for _, slide in windows}
    if len(slides) != 1:
        raise ValueError("windows of one call slide alike")
    slide = slides.pop()
    bins = df.groupBy(F.window(F.col(ts), slide).start.alias("b")).agg(*_counted(good))
    return _rates(_windows(bins, windows), target)


def _windows(bins: DataFrame, windows) -> DataFrame:
    from ..operators.windows import sliding_totals

    spans = {window: _spans(window, slide)[0] for window, slide in windows}
    totals = sliding_totals(bins, "b", ["good", "total"], spans, _seconds(windows[0][1]))
    return totals.withColumnRenamed("span", "window")


def stream_burn_rates(stream: DataFrame, ts: str, good: Column, target: float, path: str, checkpoint: str, windows=BURN_WINDOWS,
                      watermark: str = "10 minutes", trigger: str | None = None) -> StreamingQuery:
    """X5 on a stream by running totals.  The stream's state holds the open slide bins only; bins
    that the watermark closes are appended to ``{path}/bins``, and the windows that end with them to
    ``{path}/windows``, each computed once, from the bins of its own span.

    Both tables are partitioned by micro-batch and a replayed batch overwrites its own part, so
    each bin and window is there once.  A window appears when its last bin is closed.
    """
    slide = windows[0][1]
    longest = max(_spans(window, slide)[0] for window, _ in windows)
    bins = stream.withWatermark(ts, watermark).groupBy(F.window(F.col(ts), slide).alias("w")).agg(*_counted(good)) \
        .select(F.col("w.start").alias("b"), "good", "total")
    fields = "b timestamp, good long, total long, batch_id long"

    def close(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/bins/batch_id={batch_id}")
        held = spark.read.schema(fields).parquet(f"{path}/bins").filter(F.col("batch_id") <= batch_id)
        old, new = (held.filter(c).agg(F.max("b")).first()[0] for c in (F.col("batch_id") < batch_id, F.col("batch_id") == batch_id))
        if new is None:
            return
        step = F.make_dt_interval(secs=F.lit(_seconds(slide)))
        upto = F.lit(new).cast("timestamp") + step
        if old is not None:
            held = held.filter(F.col("b") > F.lit(old).cast("timestamp") - F.make_dt_interval(secs=F.lit(longest)))
        out = _rates(_windows(held, windows), target).filter(F.col("window_end") <= upto)
        if old is not None:
            out = out.filter(F.col("window_end") > F.lit(old).cast("timestamp") + step)
        out.write.mode("overwrite").parquet(f"{path}/windows/batch_id={batch_id}")

    return _trigger(bins.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(close), trigger).start()


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def incremental(source: DataFrame, target: DataFrame | None, ts: str) -> DataFrame:
    """Rows of ``source`` newer than the target's high-water mark; all rows when the target
    is missing or empty.  The mark is one scalar read from the target."""
    if target is None:
        return source
    hwm = target.agg(F.max(ts)).first()[0]
    return source if hwm is None else source.filter(F.col(ts) > F.lit(hwm))


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, keys, ts: str, watermark: str = "1 hour",
                  trigger: str | None = None, partition_cols=None, dedup_keys=None,
                  buckets: int | None = None) -> StreamingQuery:
    """Streaming dedup of repeated deliveries within the watermark, then an idempotent
    upsert per micro-batch that keeps the newest row (by ``ts``) of every key.

    ``dedup_keys`` identify one delivery (default: key + time).  The table's layout is either
    ``partition_cols`` or ``buckets`` hash buckets of the key; a micro-batch rewrites only the
    partitions its keys fall in (Parquet has no row-level merge), so choose buckets by the
    table's size.  The number is stored beside the table on the first load and must not change.

    Applied batches are kept in a marker table by (query id, batch id): a replayed batch is
    skipped, and a new query (after a checkpoint reset) starts afresh.
    """
    from ..sinks.writers import merge_or_create

    spark = stream.sparkSession
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not partition_cols:
        buckets = _layout(spark, path, buckets)
    ident = list(dedup_keys) if dedup_keys else keys + [ts]
    deduped = stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(ident)
    marks = f"{path.rstrip('/')}_applied"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        mark = spark.createDataFrame([(query_id, int(batch_id))], MARKS)
        if _has_marks(spark, marks) and not spark.read.schema(MARKS).parquet(marks).join(mark, ["query_id", "batch_id"], "left_semi").isEmpty():
            return
        src, parts = batch, partition_cols
        if not parts:
            src = src.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)))
            parts = ["_bucket"]
        merge_or_create(spark, src, path, keys, parts, order=ts)
        mark.coalesce(1).write.mode("append").parquet(marks)

    return _trigger(deduped.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert), trigger).start()


MARKS = "query_id string, batch_id long"


def _has_marks(spark: SparkSession, path: str) -> bool:
    from ..sinks.writers import path_exists

    return path_exists(spark, path)


def _layout(spark: SparkSession, path: str, buckets: int | None) -> int:
    """The bucket count of a table, stored beside it when it is new."""
    from ..sinks.writers import path_exists

    place = f"{path.rstrip('/')}_layout"
    if path_exists(spark, place):
        stored = spark.read.parquet(place).first()["buckets"]
        if buckets not in (None, stored):
            raise ValueError(f"the table has {stored} buckets, not {buckets}")
        return stored
    if buckets is None:
        raise ValueError("a new table needs its number of buckets (or partition columns)")
    spark.createDataFrame([(int(buckets),)], "buckets int").coalesce(1).write.parquet(place)
    return buckets


def dedup_latest(df: DataFrame, keys, ts: str) -> DataFrame:
    from ..operators.windows import latest_per

    return latest_per(df, keys, [ts])


def late_rows(stream_output: DataFrame, source: DataFrame, keys, slot: Column | None = None) -> DataFrame:
    """Source rows of a slot that the stream dropped as late (left anti join on keys);
    they are corrected by restating the slot, not in-stream."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = source.filter(slot) if slot is not None else source
    return src.join(stream_output.select(*keys).distinct(), keys, "left_anti")
