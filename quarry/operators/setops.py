"""Set operations over schemas and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELD_ROW = "name string, type string, nullable boolean, pos int"


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as rows (name, type, nullable, position): metadata, one row per column."""
    rows = [(f.name, f.dataType.simpleString(), bool(f.nullable), i) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, _FIELD_ROW)


def schema_diff(spark: SparkSession, old_schema: T.StructType, new_schema: T.StructType) -> DataFrame:
    """U4: added / dropped / retyped / nullability changes between two schemas."""
    o = schema_rows(spark, old_schema).alias("o")
    n = schema_rows(spark, new_schema).alias("n")
    j = o.join(n, F.col("o.name") == F.col("n.name"), "full_outer")
    change = (F.when(F.col("n.name").isNull(), "dropped").when(F.col("o.name").isNull(), "added")
              .when(F.col("o.type") != F.col("n.type"), "retyped").otherwise("nullability"))
    differs = (F.col("n.name").isNull() | F.col("o.name").isNull() | (F.col("o.type") != F.col("n.type"))
               | (F.col("o.nullable") != F.col("n.nullable")))
    return j.filter(differs).select(
        F.coalesce("o.name", "n.name").alias("column"), change.alias("change"),
        F.col("o.type").alias("old_type"), F.col("n.type").alias("new_type"),
        F.col("o.nullable").alias("old_nullable"), F.col("n.nullable").alias("new_nullable"))


# Which schema changes break readers.
BREAKING = ("dropped", "retyped", "renamed")


def next_version(diff: DataFrame, current: int) -> DataFrame:
    """Breaking if any column is dropped, retyped, or turns NOT NULL; then the version
    goes up by one, else it stays."""
    tightened = (F.col("change") == "nullability") & (F.col("old_nullable") == True) & (F.col("new_nullable") == False)  # noqa: E712
    breaking = F.col("change").isin(*BREAKING) | tightened
    return diff.agg(
        F.count(F.lit(1)).alias("changes"),
        F.count_if(breaking).alias("breaking_changes"),
    ).select("changes", "breaking_changes", (F.col("breaking_changes") > 0).alias("breaking"),
             F.when(F.col("breaking_changes") > 0, F.lit(current + 1)).otherwise(F.lit(current)).alias("version"))
