"""Lineage traversal, range conflicts, change feed, upsert and schema drift on hand-made frames."""

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.joins import overlapping
from quarry.operators.lineage import reach, task_levels
from quarry.operators.setops import next_version, schema_diff
from quarry.sinks.merge import apply_changes, change_feed, merge_upsert


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_reach_cycle_diamond_and_depth_limit(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]                 # 9-hop chain
    diamond = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")]   # diamond with a cycle back
    e = edges(spark, chain + diamond + [("a", "c0")])
    got = {r["name"]: r["depth"] for r in reach(e, "a", "downstream", 8).collect()}
    assert got["b"] == 1 and got["d"] == 2 and "a" not in got          # shortest depth, start excluded
    assert got["c0"] == 1 and got["c7"] == 8 and "c8" not in got        # depth limit 8
    up = {r["name"]: r["depth"] for r in reach(e, "d", "upstream", 8).collect()}
    assert up == {"b": 1, "c": 1, "a": 2}


def test_task_levels_longest_path(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")])
    got = {r["task"]: r["level"] for r in task_levels(e).collect()}
    assert got == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3}


def test_overlap_and_touching_ranges(spark):
    rows = [("ds", "r1", date(2024, 1, 1), date(2024, 1, 10)), ("ds", "r2", date(2024, 1, 10), date(2024, 1, 12)),
            ("ds", "r3", date(2024, 3, 1), date(2024, 3, 2)), ("other", "r4", date(2024, 1, 1), date(2024, 1, 31))]
    req = spark.createDataFrame(rows, "k string, request_id string, s date, e date")
    act = spark.createDataFrame([("ds", "a1", date(2024, 1, 5), date(2024, 2, 20)), ("ds", "a2", date(2024, 1, 12), date(2024, 1, 12))],
                                "k string, active_id string, s date, e date")
    got = {r["request_id"]: (r["conflict"], r["n_ranges"]) for r in overlapping(req, act, "k", "s", "e", bucket_days=7).collect()}
    # a range that ends on the day another starts overlaps it; one row per request
    assert got == {"r1": (True, 1), "r2": (True, 1), "r3": (False, 0), "r4": (False, 0)}


def test_change_feed_roundtrip_and_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "e")], "k int, v string")
    cf = change_feed(old, new, ["k"])
    kinds = sorted((r["k"], r["_change_type"]) for r in cf.collect())
    assert kinds == [(2, "update_postimage"), (2, "update_preimage"), (3, "update_postimage"), (3, "update_preimage"),
                     (4, "delete"), (5, "insert")]
    assert sorted(apply_changes(old, cf, ["k"]).collect()) == sorted(new.collect())


def test_upsert_twice_equals_once(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = merge_upsert(t, s, ["k"])
    twice = merge_upsert(once, s, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "B"), (3, "C")]


def test_schema_diff_and_version(spark):
    old = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()),
                        T.StructField("amount", T.IntegerType()), T.StructField("note", T.StringType())])
    new = T.StructType([T.StructField("id", T.LongType(), True), T.StructField("full_name", T.StringType()),
                        T.StructField("amount", T.DoubleType()), T.StructField("note", T.StringType()),
                        T.StructField("extra", T.StringType())])
    d = {r["column"]: r["change"] for r in schema_diff(spark, old, new).collect()}
    assert d == {"id": "nullability", "name": "dropped", "full_name": "added", "amount": "retyped", "extra": "added"}
    v = next_version(schema_diff(spark, old, new), 2).first()
    assert v["breaking"] and v["version"] == 3
    only_add = T.StructType(old.fields + [T.StructField("x", T.StringType())])
    assert next_version(schema_diff(spark, old, only_add), 2).first()["version"] == 2


def test_rank_within_hot_day_spans_partitions(spark):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from quarry.operators.windows import runs_by_day

    t0 = datetime(2024, 1, 10)
    rows = [(f"r{i:04d}", "success" if i % 3 else "failed", t0 + timedelta(seconds=i * 7), None) for i in range(600)]
    rows += [(f"s{i:04d}", "success", t0 + timedelta(days=1 + i % 5, seconds=i), None) for i in range(200)]
    df = spark.createDataFrame(rows, "dag_run_id string, state string, start_date timestamp, logical_date timestamp")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # keep 8 sort ranges
    try:
        out = runs_by_day(df.repartition(8)).collect()
        spread = df.sort(F.to_date("start_date").desc(), F.col("start_date").desc()) \
            .filter(F.to_date("start_date") == F.lit("2024-01-10").cast("date")).select(F.spark_partition_id()).distinct()
        assert spread.count() > 1                                                   # the hot day spans tasks
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by_day = {}
    for r in rows:
        by_day.setdefault(r[2].date(), []).append(r)
    want = {}
    for d, rs in by_day.items():
        for i, r in enumerate(sorted(rs, key=lambda x: (x[2], x[0]), reverse=True)):
            want[r[0]] = (i + 1, len(rs), rs and sorted(rs, key=lambda x: (x[2], x[0]))[-1][1])
    got = {r["dag_run_id"]: (r["rank_in_day"], r["runs_in_day"], r["day_state"]) for r in out}
    assert got == want


def test_ranks_do_not_hang_on_exchange_reuse(spark):
    from quarry.operators.windows import runs_by_day

    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        runs = spark.range(0, 20000, 1, 16).selectExpr(
            "concat('r', id) AS dag_run_id", "timestamp_seconds(id * 7 % 400000) AS start_date",
            "CAST(NULL AS TIMESTAMP) AS logical_date", "'ok' AS state")
        got = runs_by_day(runs).select("day", "rank_in_day", "runs_in_day", "start_date").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    days = {}
    for r in got:
        days.setdefault(r["day"], []).append(r)
    assert len(got) == 20000
    for rows in days.values():
        rows.sort(key=lambda r: r["rank_in_day"])
        assert [r["rank_in_day"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0]["runs_in_day"] == len(rows)
        assert all(a["start_date"] >= b["start_date"] for a, b in zip(rows, rows[1:]))


def test_restatement_ranges_are_checked_row_by_row(spark):
    import pytest
    from pyspark.errors import PySparkException

    from quarry.operators.restate import expand_slots_of

    def slots(a, b):
        return expand_slots_of(spark.createDataFrame([(date(*a), date(*b))], "f date, t date")).count()

    assert slots((2024, 1, 1), (2024, 3, 30)) == 90
    for bad in (((2024, 1, 1), (2024, 12, 31)), ((2024, 1, 5), (2024, 1, 1))):
        with pytest.raises(PySparkException):
            slots(*bad)


def test_cascade_has_no_depth_limit_and_ends_on_cycles(spark):
    from quarry.operators.restate import cascade

    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    e = spark.createDataFrame(chain + [("n0", "n5")], "src string, dst string")
    assert {r["name"]: r["phase"] for r in cascade(e, "n0").collect()} == {f"n{i}": i for i in range(13)}
    back = spark.createDataFrame(chain + [("n12", "n3")], "src string, dst string")
    assert cascade(back, "n0").count() == 13
    assert {r["name"]: r["phase"] for r in cascade(e, "n0", "children").collect()} == {"n0": 0, "n1": 1, "n5": 1}


def test_exact_quantile_of_ties_nulls_and_one_row(spark):
    import numpy as np

    from quarry.operators.summary import exact_quantile

    rows = [("a", float(v)) for v in [1, 1, 1, 2, 9, 9, 40]] + [("b", 5.0), ("b", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        got = {r[0]: r[1] for r in exact_quantile(df, "v", q, ["g"]).collect()}
        for g in ("a", "b", None):
            assert abs(got[g] - np.quantile([v for k, v in rows if k == g and v is not None], q)) < 1e-9
    assert abs(exact_quantile(df, "v", 0.5).first()[0] - np.quantile([v for _, v in rows if v is not None], 0.5)) < 1e-9


def test_counter_rate_after_a_reset(spark):
    from datetime import datetime, timedelta

    from quarry.operators.slo import counter_rate

    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=i), "c", v) for i, v in enumerate([90.0, 100.0, 0.0, 5.0])]
    got = counter_rate(spark.createDataFrame(rows, "TimeGenerated timestamp, Name string, Val double"), ["Name"], "5 minutes").first()
    assert abs(got["rate_per_s"] - 15 / 300) < 1e-12


def test_tag_values_are_whole(spark):
    from quarry.functions.scalar import tag_value

    df = spark.range(1).selectExpr("concat('source:', repeat('X', 2000000)) AS t")
    assert df.select(F.length(tag_value("t", "source"))).first()[0] == 2000000
