"""Tables written to the shared folder the cluster names, and a distributed running sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.session import scratch_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.

    Cuts the lineage with replicated files (no executor-local blocks), so a lost executor
    costs a task and not the job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` .. that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` staged with a number for each row, and the name of that column (none that ``df`` has)."""
    col = free(df, "_row_id")
    return stage(df.withColumn(col, F.monotonically_increasing_id()), name), col


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def indexed(df: DataFrame, order: list, name: str, value: str | None = None,
            out: str = "before") -> DataFrame:
    """Adds the running total of ``value`` (or of 1) over the rows before each row in ``order``.

    Range-partitions by ``order``, so no task sees more than its range; the offsets of the
    ranges are one row per partition.  Rows equal in ``order`` stay in one range.
    """
    val = F.col(value) if value else F.lit(1)
    parts = stage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), name)
    tot = parts.groupBy("_pid").agg(F.sum(val).alias("_tot"))
    offs = tot.select("_pid", (F.sum("_tot").over(Window.orderBy("_pid")) - F.col("_tot")).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (parts.withColumn("_in", F.coalesce(F.sum(val).over(w), F.lit(0)))
            .join(F.broadcast(offs), "_pid")
            .withColumn(out, (F.col("_in") + F.col("_off")).cast("long"))
            .drop("_pid", "_in", "_off"))
