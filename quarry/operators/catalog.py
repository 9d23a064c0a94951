"""Catalogue, dataset cards, contracts and pipeline registry.

Catalogue listings are metadata (one row per table or column); dataset cards aggregate each
table once (count and newest time in the same pass).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..quality import engine
from ..quality.rules import MaxStaleness, RunContext, SchemaIs, UniqueKey

LAYERS = ("bronze", "silver", "gold", "sandbox")


def list_tables(spark: SparkSession, layer: str | None = None) -> DataFrame:
    """Tables of the layer databases (or one layer), sorted by (layer, name)."""
    dbs = [layer] if layer else [d.name for d in spark.catalog.listDatabases() if d.name in LAYERS]
    rows = [(t.name, db, db, t.tableType) for db in dbs for t in spark.catalog.listTables(db)]
    df = spark.createDataFrame(rows, "name string, schema string, layer string, table_type string")
    return df.orderBy("layer", "name")


def flatten_fields(schema: T.StructType, prefix: str = ""):
    """Column listing with nested structs (and arrays of structs) flattened by path."""
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        yield path, f.dataType.simpleString(), bool(f.nullable)
        dt = f.dataType
        while isinstance(dt, T.ArrayType):
            dt = dt.elementType
        if isinstance(dt, T.StructType):
            yield from flatten_fields(dt, path + ".")


def table_schema(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of tables (name -> DataFrame) as rows, nested fields flattened."""
    rows = [(name, path, typ, nullable, i) for name, df in tables.items()
            for i, (path, typ, nullable) in enumerate(flatten_fields(df.schema))]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, position int")


def dataset_cards(tables: dict[str, DataFrame], summaries: DataFrame | None = None,
                  time_candidates=("updated_at", "_ingestion_date", "ts", "o_orderdate", "l_shipdate")) -> DataFrame:
    """Per dataset: row count and last update (one scan each), and whether it has DQ."""
    parts = []
    for name, df in tables.items():
        cols = {c.lower(): c for c in df.columns}
        tcol = next((cols[c] for c in time_candidates if c in cols), None)
        last = F.max(F.col(tcol)).cast("timestamp_ntz") if tcol else F.lit(None).cast("timestamp_ntz")
        parts.append(df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("row_count"), last.alias("last_updated")))
    cards = reduce(lambda a, b: a.unionByName(b), parts)
    if summaries is None:
        return cards.withColumn("has_dq", F.lit(False))
    s = summaries.select(F.col("dataset").alias("__d")).distinct()
    return cards.join(s, cards["dataset"] == s["__d"], "left").select(
        "dataset", "row_count", "last_updated", F.col("__d").isNotNull().alias("has_dq"))


def check_contract(df: DataFrame, contract: dict, as_of=None) -> DataFrame:
    """C4: grain unique (R6), schema (R14), cadence (R11) and partition key present."""
    rules = []
    if contract.get("grain"):
        rules.append(UniqueKey("contract_grain", contract["grain"]))
    if contract.get("schema") is not None:
        rules.append(SchemaIs("contract_schema", contract["schema"], check_nullable=contract.get("check_nullable", False)))
    if contract.get("time_column"):
        rules.append(MaxStaleness("contract_cadence", contract["time_column"], max_age_hours=contract.get("max_age_hours", 24)))
    res = engine.evaluate(df, rules, RunContext(df.sparkSession, as_of=as_of))
    keys = contract.get("partition_keys") or []
    missing = [k for k in keys if k not in df.columns]
    pk = df.sparkSession.createDataFrame(
        [("contract_partition_key", "schema", "critical", "FAIL" if missing else "PASS",
          f"missing partition keys: {missing}" if missing else "partition keys present",
          str(len(missing)), "0", len(missing), "schema")],
        "rule_name string, rule_type string, severity string, status string, message string, actual_value string, "
        "expected_value string, affected_rows long, check_family string")
    return res.unionByName(pk)


def preview(df: DataFrame, where: Column | str | None = None, columns=None, limit: int = 100, order=None) -> DataFrame:
    """Filter, project, first ``limit`` rows (ordered when ``order`` is given)."""
    if where is not None:
        df = df.filter(where)
    if columns:
        df = df.select(*columns)
    if order:
        df = df.orderBy(*([order] if isinstance(order, str) else order))
    return df.limit(limit)


def register_pipeline(registry: DataFrame, rows: DataFrame, key: str = "dag_id") -> DataFrame:
    """G1: upsert pipeline rows into the registry (new keys inserted, known keys replaced)."""
    from ..sinks.merge import merge_upsert

    return merge_upsert(registry, rows, [key])


def soft_delete(registry: DataFrame, ids: DataFrame, at, key: str = "dag_id") -> DataFrame:
    """G1: mark pipelines deleted (set ``deleted_at``) without removing their rows."""
    a = at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
    hit = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    j = registry.join(hit, key, "left")
    return j.withColumn("deleted_at", F.when(F.col("__hit"), F.coalesce(F.col("deleted_at"), a)).otherwise(F.col("deleted_at"))) \
        .drop("__hit")


def owned(registry: DataFrame, owner: str | None = None) -> DataFrame:
    """G1: live pipelines per owner with their count (or of one owner)."""
    live = registry.filter(F.col("deleted_at").isNull())
    if owner is not None:
        live = live.filter(F.col("owner_email") == owner)
    return live.groupBy("owner_email").agg(F.count(F.lit(1)).alias("pipelines"),
                                           F.min("dag_id").alias("first_dag_id"))


def pipeline_cards(pipelines: DataFrame, runs: DataFrame) -> DataFrame:
    """Pipeline card = registry row + newest run (J12) + active / failed flags."""
    from .joins import with_last_run

    c = with_last_run(pipelines, runs.select("dag_id", "dag_run_id", "state", "start_date"))
    return c.select("*", (F.col("deleted_at").isNull() & ~F.col("is_paused")).alias("is_active"),
                    (F.col("last_state") == "failed").alias("last_failed"))


def pipeline_counts(cards: DataFrame) -> DataFrame:
    """A20 for pipelines: active / paused / failed totals."""
    return cards.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"),
                     F.count_if(F.col("is_paused")).alias("paused"), F.count_if("last_failed").alias("failed"))
