"""Catalogue listing, registration and dataset cards."""

from pyspark.sql import functions as F

from quarry.operators.catalog import dataset_cards, list_tables, owned, soft_delete, table_schema
from quarry.sinks.writers import overwrite_slot, register


def test_register_list_and_cards(spark, tmpdir_path):
    df = spark.range(20).withColumn("p", F.col("id") % 3).withColumn("ts", F.current_timestamp())
    overwrite_slot(df, f"{tmpdir_path}/t", ["p"])
    register(spark, "gold", "cards_t", f"{tmpdir_path}/t", partitioned=True)
    tables = {r["name"]: r for r in list_tables(spark, "gold").collect()}
    assert "cards_t" in tables and tables["cards_t"]["layer"] == "gold"
    assert spark.table("gold.cards_t").count() == 20
    cards = dataset_cards({"cards_t": spark.table("gold.cards_t")},
                          spark.createDataFrame([("cards_t",)], "dataset string")).first()
    assert cards["row_count"] == 20 and cards["has_dq"] and cards["last_updated"] is not None


def test_nested_schema_flattened(spark):
    df = spark.createDataFrame([], "a int, s struct<x: int, y: array<struct<z: string>>>")
    cols = [r["column"] for r in table_schema(spark, {"t": df}).collect()]
    assert cols == ["a", "s", "s.x", "s.y", "s.y.z"]


def test_soft_delete_and_owned(spark):
    reg = spark.createDataFrame([("p1", "a@x", None), ("p2", "a@x", None), ("p3", "b@x", None)],
                                "dag_id string, owner_email string, deleted_at timestamp")
    gone = spark.createDataFrame([("p2",)], "dag_id string")
    out = {r["owner_email"]: r["pipelines"] for r in owned(soft_delete(reg, gone, "2024-01-01")).collect()}
    assert out == {"a@x": 1, "b@x": 1}
