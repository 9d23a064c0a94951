"""A1/A2: automatic profile of a DataFrame in one aggregation pass.

All per-column statistics and the row count come from one ``agg`` (partial aggregation on
every task, one tiny final merge).  Wide tables are split into chunks of ``chunk`` columns so
generated code stays under the JVM method limit; each chunk is one more scan.

Exact distinct counts stay out of that pass: beside the minimum of a string, Spark groups by
sorting every row of the task.  A first pass estimates them.  Columns whose values fit into
``TASK_VALUES`` entries together are counted in one hashed pass, each other one apart, dealt by
value over as many partitions as its values need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)

TASK_VALUES = 1 << 18  # values that a task counts in its hash table

PROFILE_COLUMNS = ["column", "type", "nullable", "null_count", "null_rate", "distinct_count",
                   "min_value", "max_value", "mean", "stddev"]


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC)


def _orderable(dt: T.DataType) -> bool:
    return isinstance(dt, T.AtomicType) or isinstance(dt, (T.ArrayType, T.StructType)) and not _has_map(dt)


def _has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.ArrayType):
        return _has_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_has_map(f.dataType) for f in dt.fields)
    return False


def _key(f: T.StructField) -> Column:
    """What distinct counts of a column count."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.AtomicType):
        return c
    return F.when(c.isNotNull(), F.xxhash64(F.to_json(c) if _has_map(f.dataType) else c))


def _many_valued(df: DataFrame, fields: list[T.StructField]) -> dict[int, int]:
    """The columns to count apart, with their numbers of values: those with the most distinct values, so that
    the others fit into ``TASK_VALUES`` together.  One pass of estimates, one row to the driver."""
    got = df.agg(*[a for f in fields for a in (F.approx_count_distinct(_key(f)), F.count(_key(f)))]).first()
    room, apart = TASK_VALUES, {}
    for i in sorted(range(len(fields)), key=lambda i: got[2 * i]):
        room -= got[2 * i]
        if room < 0:
            apart[i] = got[2 * i + 1]
    return apart


def with_exact_distinct(row: DataFrame, df: DataFrame, fields: list[T.StructField], prefix: str = "p") -> DataFrame:
    """The aggregate row with the exact distinct counts of the fields.

    Of a column counted apart, values first meet with their like from the same input partition, so a frequent
    one is spread; then all."""
    apart = _many_valued(df, fields) if fields else {}
    few = [i for i in range(len(fields)) if i not in apart]
    if few:
        row = row.crossJoin(df.agg(*[F.count_distinct(_key(fields[i])).alias(f"{prefix}{i}_distinct") for i in few]))
    for i, values in apart.items():
        key = _key(fields[i])
        if isinstance(fields[i].dataType, (T.FloatType, T.DoubleType)):
            key = (key.cast("double") + F.lit(0.0)).cast("string")  # one zero, one NaN: a plain key to deal by
        n = -(-values // TASK_VALUES)
        v = df.filter(key.isNotNull()).select(key.alias("v"), F.spark_partition_id().alias("p"))
        v = v.repartition(n, "v", "p").distinct().select("v").repartition(n, "v").distinct()
        row = row.crossJoin(v.agg(F.count(F.lit(1)).alias(f"{prefix}{i}_distinct")))
    return row


def profile_aggs(fields: list[T.StructField], exact_distinct: bool = False, prefix: str = "p") -> list[Column]:
    """Aggregate expressions for the given fields (aliases ``{prefix}{i}_...``); exact distinct counts are left
    to ``with_exact_distinct``."""
    out: list[Column] = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        p = f"{prefix}{i}_"
        out.append(F.coalesce(F.sum(c.isNull().cast("long")), F.lit(0)).alias(p + "nulls"))
        if not exact_distinct:
            out.append(F.approx_count_distinct(_key(f)).alias(p + "distinct"))
        if _orderable(f.dataType) and isinstance(f.dataType, T.AtomicType):
            out.append(F.min(c).cast("string").alias(p + "min"))
            out.append(F.max(c).cast("string").alias(p + "max"))
        else:
            out.append(F.lit(None).cast("string").alias(p + "min"))
            out.append(F.lit(None).cast("string").alias(p + "max"))
        if is_numeric(f.dataType):
            out.append(F.avg(c.cast("double")).alias(p + "mean"))
            out.append(F.stddev_samp(c.cast("double")).alias(p + "stddev"))
        else:
            out.append(F.lit(None).cast("double").alias(p + "mean"))
            out.append(F.lit(None).cast("double").alias(p + "stddev"))
    return out


def profile_rows(fields: list[T.StructField], prefix: str = "p", rows_col: str = "__rows") -> Column:
    """Array of one struct per column, built from the aggregate row (long form)."""
    rows = F.col(rows_col)
    items = []
    for i, f in enumerate(fields):
        p = f"{prefix}{i}_"
        nulls = F.col(p + "nulls").cast("long")
        items.append(F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(bool(f.nullable)).alias("nullable"),
            nulls.alias("null_count"),
            F.round(F.when(rows > 0, nulls / rows).otherwise(F.lit(0.0)), 6).alias("null_rate"),
            F.col(p + "distinct").cast("long").alias("distinct_count"),
            F.col(p + "min").alias("min_value"),
            F.col(p + "max").alias("max_value"),
            F.col(p + "mean").alias("mean"),
            F.col(p + "stddev").alias("stddev"),
        ))
    return F.array(*items)


def profile(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """A1: long-form profile, one row per column (``PROFILE_COLUMNS`` plus ``rows``), in one
    scan whatever the width; exact distinct counts take two more scans, and one for each column
    with many values."""
    fields = list(df.schema.fields)
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *profile_aggs(fields, exact_distinct))
    if exact_distinct:
        row = with_exact_distinct(row, df, fields)
    long = row.select(F.col("__rows").alias("rows"), F.explode(profile_rows(fields)).alias("c"))
    return long.select(*[F.col(f"c.{n}").alias(n) for n in PROFILE_COLUMNS], "rows")


def schema_json(df: DataFrame) -> str:
    """A2: the schema as JSON text (metadata only, no job)."""
    return df.schema.json()


def profiles_json(profile_long: DataFrame) -> DataFrame:
    """Encode a long profile to the JSON array stored in ``column_profiles`` (one row).

    The profile has one row per column, so the collected list is bounded by the width.
    """
    return profile_long.agg(
        F.max("rows").alias("rows_written"),
        F.to_json(F.sort_array(F.collect_list(F.struct(
            F.col("column").alias("name"), "type", "nullable", "null_count", "null_rate",
            "distinct_count", "min_value", "max_value", "mean", "stddev")))).alias("column_profiles"))
