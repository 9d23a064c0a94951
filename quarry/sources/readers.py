"""Scans and sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import DATE_KEY_COLUMN


class EmptySourceError(RuntimeError):
    pass


def read_source(spark: SparkSession, path, fmt: str = "parquet", options: dict | None = None,
                schema: T.StructType | str | None = None) -> DataFrame:
    """Scan by format with reader options (``path`` may be a list or hold globs)."""
    r = spark.read.format(fmt)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_registered(spark: SparkSession, registry: DataFrame, slug: str, sub: str = "",
                    fmt: str | None = None, options: dict | None = None) -> DataFrame:
    """Look a source up by slug (one registry row: type + config map) and scan it.

    ``config`` keys: ``account``, ``container``, ``base_path``, optional ``format``.
    """
    row = registry.filter(F.col("name") == slug).select("source_type", "config").first()
    if row is None:
        raise KeyError(f"no registered source {slug!r}")
    cfg = dict(row["config"] or {})
    if row["source_type"] == "adls_gen2":
        root = f"abfss://{cfg['container']}@{cfg['account']}.dfs.core.windows.net"
    else:
        root = cfg.get("root", "")
    path = "/".join(p.strip("/") for p in [root, cfg.get("base_path", ""), sub] if p)
    if root.startswith("/"):
        path = "/" + path.lstrip("/")
    return read_source(spark, path, fmt or cfg.get("format", "parquet"), options)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Table by name."""
    return spark.table(name)


def read_slot(df: DataFrame, layer: str, slot: datetime) -> DataFrame:
    """Partition-slot filter: bronze by year/month/day, other layers by ``__date`` at hour 00.

    Filters are on partition columns, so the scan prunes partitions statically.
    """
    if layer == "bronze":
        return df.filter((F.col("__year") == slot.year) & (F.col("__month") == slot.month) & (F.col("__day") == slot.day))
    return df.filter(F.col(DATE_KEY_COLUMN) == slot.strftime("%d_%m_%Y_00"))


def source_filter(df: DataFrame, expr: str | Column | None) -> DataFrame:
    """Free-form source filter."""
    return df if expr in (None, "") else df.filter(expr)


def assert_not_empty(df: DataFrame, desc: str = "source") -> DataFrame:
    """Fail fast on an empty source (``isEmpty`` stops at the first row)."""
    if df.isEmpty():
        raise EmptySourceError(f"{desc} is empty")
    return df


def ingest_csv(spark: SparkSession, path, sep: str = ";", source_name: str | None = None,
               ingestion_date: str | None = None) -> DataFrame:
    """Delimited text with a header, all columns as strings (no inference), a byte-order
    mark stripped from the first header, plus ingest columns."""
    df = (spark.read.option("header", "true").option("sep", sep).option("inferSchema", "false")
          .option("encoding", "UTF-8").csv(path))
    renamed = [c.lstrip("\ufeff") for c in df.columns]
    df = df.toDF(*renamed)
    return df.select("*", F.current_timestamp().alias("_ingested_at"),
                     F.lit(ingestion_date or datetime.utcnow().strftime("%Y-%m-%d")).alias("_ingestion_date"),
                     F.lit(source_name).cast("string").alias("_source"),
                     F.col("_metadata.file_path").alias("_source_file"))


def jdbc_options(url: str, table: str, partition_column: str | None = None, lower=None, upper=None,
                 num_partitions: int | None = None, fetch_size: int = 10000, props: dict | None = None) -> dict:
    """Reader options for a parallel JDBC scan (split on a numeric / date column)."""
    o = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("a partitioned JDBC scan needs lower, upper and num_partitions")
        o.update({"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                  "numPartitions": str(num_partitions)})
    o.update({k: str(v) for k, v in (props or {}).items()})
    return o


def read_jdbc(spark: SparkSession, url: str, table: str, **kw) -> DataFrame:
    """JDBC table scan with partitioned reads."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kw)).load()


def latest_version(df: DataFrame, version_col: str = "version") -> DataFrame:
    """Rows of the newest version only (``v1, v2 …`` as a column or a partition).

    The newest version is one scalar; the filter on it prunes older version partitions.
    """
    num = F.regexp_extract(F.col(version_col).cast("string"), r"(\d+)$", 1).cast("int")
    newest = df.select(num.alias("n")).agg(F.max("n")).first()[0]
    return df.filter(num == F.lit(newest))


def ingest_manifest(df: DataFrame) -> DataFrame:
    """Per input file: size, row count, checksum of the rows (a sum of row hashes: free of
    order, and repeated rows count), ingest time."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_size").alias("__s")) \
        .groupBy("__f").agg(F.max("__s").alias("file_size"), F.count(F.lit(1)).alias("rows"),
                            F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("checksum")) \
        .select(F.col("__f").alias("file"), "file_size", "rows", "checksum",
                F.current_timestamp().alias("ingested_at"))
