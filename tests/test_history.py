"""SPC anomaly and history windows on hand-made metric series."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.quality.history import metrics_long, spc
from quarry.quality import engine
from quarry.quality import profile as prof
from quarry.quality.profile import profile
from quarry.quality.rules import RunContext


def series(spark, values, metric="rows_written"):
    t0 = datetime(2024, 1, 1)
    rows = [("d", f"r{i}", t0 + timedelta(days=i), metric, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset_path string, run_id string, run_timestamp timestamp, metric_name string, value double")


def test_minimum_history_and_flat(spark):
    six = spc(series(spark, [10, 11, 9, 10, 11, 9, 50])).collect()     # last run has 6 prior points
    assert six == []
    flat = spc(series(spark, [10] * 8 + [99])).collect()              # stddev 0 -> no row
    assert flat == []


def test_warning_and_critical(spark):
    base = [10, 12, 10, 12, 10, 12, 10, 12]                           # mean 11, population sd 1
    warn = {r["run_id"]: r for r in spc(series(spark, base + [14.1])).collect()}["r8"]
    crit = {r["run_id"]: r for r in spc(series(spark, base + [15.6])).collect()}["r8"]
    assert abs(warn["stddev_30d"] - 1.0) < 1e-9 and warn["is_anomaly"] and warn["severity"] == "warning"
    assert crit["severity"] == "critical" and abs(crit["z_score"] - 4.6) < 1e-9
    ok = {r["run_id"]: r for r in spc(series(spark, base + [11.5])).collect()}["r8"]
    assert not ok["is_anomaly"] and ok["severity"] == "info"


def test_bad_profile_json_is_skipped(spark):
    rows = [("d", "r1", datetime(2024, 1, 1), 10, '[{"name": "a", "null_rate": 0.5}]'),
            ("d", "r2", datetime(2024, 1, 2), 11, "{not json")]
    auto = spark.createDataFrame(rows, "dataset_path string, run_id string, run_timestamp timestamp, rows_written long, column_profiles string")
    m = {(r["run_id"], r["metric_name"]): r["value"] for r in metrics_long(auto).collect()}
    assert m == {("r1", "rows_written"): 10.0, ("r1", "null_rate__a"): 0.5, ("r2", "rows_written"): 11.0}


def test_profile_sample_stddev_and_null_rate(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, "x"), (3.0, "y")], "v double, s string")
    p = {r["column"]: r for r in profile(df, exact_distinct=True).collect()}
    assert abs(p["v"]["stddev"] - 1.0) < 1e-12                        # sample form
    assert p["s"]["null_rate"] == round(1 / 3, 6) and p["s"]["distinct_count"] == 2 and p["s"]["mean"] is None
    e = profile(spark.createDataFrame([], "a int")).collect()
    assert e[0]["null_rate"] == 0.0 and e[0]["rows"] == 0


def test_profile_many_values_counted_apart(spark, monkeypatch):
    """Columns with many values leave the one hash table of the pass; nulls, zeros, NaN and frequent values count as before."""
    df = spark.range(4000, numPartitions=3).select(
        F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), F.col("id") % 1500)).alias("s"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 0, -0.0).when(F.col("id") % 7 == 1, 0.0)
        .otherwise(F.col("id") / 3).alias("x"), (F.col("id") % 3).cast("int").alias("few"),
        F.when(F.col("id") % 4 > 0, F.array("id")).alias("a"), F.lit(None).cast("string").alias("none"))
    want = repr(profile(df, exact_distinct=True).collect())
    assert not prof._many_valued(df, list(df.schema.fields))
    monkeypatch.setattr(prof, "TASK_VALUES", 300)
    assert set(prof._many_valued(df, list(df.schema.fields))) == {0, 1, 2, 4}
    frame = profile(df, exact_distinct=True)
    assert repr(frame.collect()) == want
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "REPARTITION_BY_NUM" in plan  # no task sorts its rows, values are dealt
    got = engine.evaluate_all(df, [], RunContext(spark), with_profile=True, exact_distinct=True).profile.collect()
    assert repr(got) == want
    count = {r["column"]: r["distinct_count"] for r in got}
    xs = {repr(r["x"] + 0.0) for r in df.collect()}
    assert count == {"k": 4000, "s": 1200, "x": len(xs), "few": 3, "a": 3000, "none": 0}
