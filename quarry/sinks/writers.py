"""Table writes (K1, K2, K5-K9, K12, K13, K15, K16, K18) on Parquet folders.

Partitioned tables keep a stored contract (``tables``), by which every rewrite reads them.

Delta is not on the class path here, so the table format is Parquet with dynamic partition
overwrite.  Rules that keep writes safe:

* a slot replace only touches the partitions present in the data (dynamic overwrite);
* when the data to write is computed from the same folder it replaces, it is first
  materialised with a reliable checkpoint (shared checkpoint folder), so no task reads a file
  that the commit removes and a lost executor recomputes from the checkpoint;
* row counts come from ``observe`` on the write itself, not from a second scan;
* the tracker marker is written last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import DATE_KEY_COLUMN
from ..session import cut_lineage
from . import tables

FMT = "parquet"


def _writer(df: DataFrame, mode: str, partition_cols=None, fmt: str = FMT, options: dict | None = None):
    w = df.write.mode(mode).format(fmt)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    return w


def path_exists(spark: SparkSession, path: str, fmt: str = FMT) -> bool:
    try:
        spark.read.format(fmt).load(path).schema
        return True
    except AnalysisException:
        return False


def rebalance(df: DataFrame, partition_cols) -> DataFrame:
    """Group rows of a partition into few tasks before a partitioned write, with AQE splitting
    a partition that is too large (a hot slot is spread over several files, not one task)."""
    return df.hint("rebalance", *partition_cols) if partition_cols else df


def _contract(df: DataFrame, path: str, partition_cols, fmt: str) -> None:
    if partition_cols and fmt == FMT:
        tables.keep_contract(df, path, partition_cols)


def overwrite_slot(df: DataFrame, path: str, partition_cols, fmt: str = FMT) -> None:
    """K1: replace the partition slots present in ``df``; other slots stay."""
    _contract(df, path, partition_cols, fmt)
    _writer(rebalance(df, partition_cols), "overwrite", partition_cols, fmt,
            {"partitionOverwriteMode": "dynamic"}).save(path)


def append(df: DataFrame, path: str, partition_cols=None, fmt: str = FMT) -> None:
    """K2: append mode."""
    _contract(df, path, partition_cols, fmt)
    _writer(rebalance(df, partition_cols), "append", partition_cols, fmt).save(path)


def write_guarded(df: DataFrame, path: str, partition_cols, fmt: str = FMT) -> int:
    """K5: slot replace that writes nothing (and reports 0) for an empty result.

    The row count is observed during the write.  With dynamic overwrite an empty frame
    replaces no partition, so a zero-row run never wipes earlier data.
    """
    if not partition_cols:
        raise ValueError("a guarded write replaces partitions: give partition columns")
    _contract(df, path, partition_cols, fmt)
    obs = Observation("quarry_write")
    observed = rebalance(df, partition_cols).observe(obs, F.count(F.lit(1)).alias("rows"))
    _writer(observed, "overwrite", partition_cols, fmt, {"partitionOverwriteMode": "dynamic"}).save(path)
    return int(obs.get.get("rows", 0) or 0)


def register(spark: SparkSession, db: str, table: str, path: str, fmt: str = FMT, partitioned: bool = False,
             slots: DataFrame | None = None) -> str:
    """K6: ``CREATE TABLE IF NOT EXISTS db.table USING fmt LOCATION path`` (+ partitions).

    ``slots`` holds the partition values just written (one row per slot): only those are added,
    so a slot's run does not list the whole table.  Without it all partitions are recovered,
    which is for adopting an existing folder.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    name, have = f"`{db}`.`{table}`", tables.load_contract(spark, path)
    # the stored types, so that a partition value such as "01" stays as it is
    columns, by = "", ""
    if partitioned and have is not None:
        columns = f"({tables.table_ddl(have[0])})"
        by = "PARTITIONED BY (" + ", ".join(f"`{c}`" for c in have[1]) + ")"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} {columns} USING {fmt} {by} LOCATION {tables.sql_text(path)}")
    if partitioned and slots is not None:
        cols = slots.columns
        rows = slots.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).distinct().collect()
        specs = [tables.partition_spec(cols, r) for r in rows]
        if specs:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(specs)}")
            spark.catalog.refreshTable(name)
    elif partitioned:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return f"{db}.{table}"


def dq_table(dataset: str, kind: str, base: str) -> tuple[str, str]:
    """K8: location and table name of a quality table of a dataset.

    ``silver/orders_clean`` + ``rules`` -> (``{base}/silver/_dq/rules/silver_orders_clean``,
    ``_dq.silver_orders_clean_rules``).
    """
    clean = dataset.strip("/")
    safe = clean.replace("/", "_")
    container = clean.split("/")[0]
    return f"{base.rstrip('/')}/{container}/_dq/{kind}/{safe}", f"_dq.{safe}_{kind}"


def append_results(df: DataFrame, path: str) -> None:
    """K7: append quality rows, one file per run, under the run's date.

    A run's rows are few (one per rule, metric or column), so one file holds them; readers of a
    time range open only its days.  ``compact_results`` merges a day's files.
    """
    day = F.date_format("run_timestamp", "yyyy_MM_dd")
    append(df.withColumn(RESULTS_DAY, day).coalesce(1), path, [RESULTS_DAY])


RESULTS_DAY = "_run_day"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Read a quality table whose files may carry older / newer schemas."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop(RESULTS_DAY)


def compact_results(spark: SparkSession, path: str, day: str | None = None) -> None:
    """One file per day (or of one day, ``yyyy_MM_dd``)."""
    df = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(path)
    df = df.filter(F.col(RESULTS_DAY) == day) if day else df
    overwrite_slot(cut_lineage(df), path, [RESULTS_DAY])


TRACKER_SCHEMA = ("version string, job string, table string, partition string, status string, "
                  "rows_written long, completed_at timestamp, environment string")


def mark_done(spark: SparkSession, tracker_path: str, job: str, table: str, slot_key: str, rows: int,
              status: str = "success", version: str = "1", environment: str = "dev") -> None:
    """K9: one tracker row for a finished slot; call it after the data write."""
    row = [(version, job, table, slot_key, status, int(rows), None, environment)]
    # Spark's clock, as in ``clear_markers``: an instant, whatever the time zone of the driver
    marker = spark.createDataFrame(row, TRACKER_SCHEMA).withColumn("completed_at", F.current_timestamp())
    append(marker, tracker_path)


def read_tracker(spark: SparkSession, tracker_path: str) -> DataFrame:
    if not path_exists(spark, tracker_path):
        return spark.createDataFrame([], TRACKER_SCHEMA)
    return spark.read.parquet(tracker_path)


def latest_marks(tracker: DataFrame, keys=("table", "partition")) -> DataFrame:
    """The newest marker of each slot; older ones are history."""
    from ..operators.windows import latest_per

    return latest_per(tracker, list(keys), ["completed_at"])


def merge_or_create(spark: SparkSession, source: DataFrame, path: str, keys, partition_cols=None,
                    order: str | None = None) -> str:
    """First load creates the table; later loads upsert by key.

    The first load is an upsert into an empty table, so keys that repeat in it are settled the
    same way.  Later, only partitions that the source touches are read, merged and replaced:
    those it writes to, and those that hold one of its keys now, so a key whose partition
    changes leaves its old place.  The merged slice is checkpointed before the overwrite because
    it is read from the same folder.
    """
    from .merge import merge_upsert

    keys = [keys] if isinstance(keys, str) else list(keys)
    if not path_exists(spark, path):
        merged = merge_upsert(source.limit(0), source, keys, order)
        _contract(merged, path, partition_cols, FMT)
        _writer(rebalance(merged, partition_cols), "overwrite", partition_cols).save(path)
        return "created"
    target = tables.read_stored(spark, path, partition_cols or ())
    source = source.select(*target.columns)
    if not partition_cols:
        _writer(cut_lineage(merge_upsert(target, source, keys, order)), "overwrite").save(path)
        return "merged"
    parts = list(partition_cols)
    if tables.load_contract(spark, path) is None:  # a folder of unknown types: its partition values are text
        source = source.withColumns({c: F.col(c).cast("string") for c in parts})
    held = tables.keep_where(target, source.select(*keys).distinct(), keys).select(*parts)
    touched = cut_lineage(source.select(*parts).unionByName(held).distinct())
    slice_ = tables.keep_where(target, touched, parts)
    merged = cut_lineage(merge_upsert(slice_, source, keys, order))
    overwrite_slot(merged, path, parts)
    # a partition whose rows all moved away gets no row to replace it with
    tables.drop_partitions(spark, path, parts, tables.keep_where(touched, merged.select(*parts).distinct(), parts, "left_anti"))
    return "merged"


def compact(spark: SparkSession, path: str, partition_cols, where=None) -> None:
    """Rewrite the small files of the chosen partitions into few right-sized files.

    ``rebalance`` lets AQE aim each output file at the advisory partition size and split a
    partition that is too large, so a hot slot is not funnelled into one task.  The slice is
    checkpointed first because it is read from the folder it replaces.  ``tables.compact_files`` merges
    only the files under a target size.
    """
    df = tables.read_stored(spark, path, partition_cols)
    if where is not None:
        df = df.filter(where)
    overwrite_slot(cut_lineage(df), path, partition_cols)


def cluster_by(df: DataFrame, cols, n: int | None = None) -> DataFrame:
    """Multi-column clustering: range partitioning plus sort inside each partition."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    r = df.repartitionByRange(n, *cols) if n else df.repartitionByRange(*cols)
    return r.sortWithinPartitions(*cols)


def expire(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows to keep under a retention of ``days`` days before ``as_of``."""
    a = F.lit(as_of).cast("timestamp_ntz") if not hasattr(as_of, "alias") else as_of
    return df.filter(F.col(ts) >= a - F.expr(f"INTERVAL {int(days)} DAYS"))


def expire_table(spark: SparkSession, path: str, ts: str, days: int, as_of, partition_cols) -> None:
    """K15 on a table: partitions with only expired rows are dropped, mixed ones rewritten; the
    others are not read beyond their time column.  A row without a time stays."""
    parts = list(partition_cols)
    df = tables.read_stored(spark, path, parts)
    a = F.lit(as_of).cast("timestamp_ntz")
    old = F.coalesce(F.col(ts) < a - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))
    state = cut_lineage(df.groupBy(*parts).agg(F.count_if(old).alias("__old"), F.count(F.lit(1)).alias("__all")).filter("__old > 0"))
    touched = tables.keep_where(df, state.filter("__old < __all"), parts)
    overwrite_slot(cut_lineage(touched.filter(~old)), path, parts)
    tables.drop_partitions(spark, path, parts, state.filter("__old = __all"))


def refresh_gold(spark: SparkSession, query, path: str, partition_cols=None) -> None:
    """Rebuild a table from a query (SQL text or DataFrame), replacing it whole, also the
    partitions that the new result no longer has (static overwrite)."""
    df = spark.sql(query) if isinstance(query, str) else query
    _writer(cut_lineage(df), "overwrite", partition_cols, options={"partitionOverwriteMode": "static"}).save(path)


def archive_json(df: DataFrame, ts: str, path: str) -> None:
    """Monthly gzip NDJSON archive partitioned by year and month."""
    out = df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))
    out.write.mode("append").partitionBy("year", "month").option("compression", "gzip").json(path)


__all__ = ["overwrite_slot", "append", "write_guarded", "register", "dq_table", "append_results", "read_results",
           "mark_done", "read_tracker", "merge_or_create", "compact", "cluster_by", "expire", "expire_table",
           "refresh_gold", "archive_json", "latest_marks", "compact_results", "DATE_KEY_COLUMN"]
