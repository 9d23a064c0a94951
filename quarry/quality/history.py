"""History operators over the per-run metrics table.

The metrics table has one row per run (and per column for null rates), so these windows run
over short series; the heavy part — turning raw rows into per-run metrics — is one grouped
aggregation (``slot_metrics``) with partial aggregation.  History is prior runs only unless
``include_current`` (the reference's order of writes makes it include the current run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .results import FAIL, PASS, result_struct

MICROS_PER_DAY = 86_400_000_000

PROFILE_JSON = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("null_rate", T.DoubleType()),
]))


def slot_metrics(df: DataFrame, slot: Column, columns: list[str], dataset: str) -> DataFrame:
    """Per slot (= run): ``rows_written`` and ``null_rate__<col>`` as long-form metric rows.

    One grouped aggregation; the per-slot arrays are as wide as ``columns``.
    """
    n = F.count(F.lit(1))
    aggs = [n.alias("rows")] + [F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(f"n{i}")
                                for i, c in enumerate(columns)]
    g = df.groupBy(slot.alias("run_timestamp")).agg(*aggs)
    items = [F.struct(F.lit("rows_written").alias("metric_name"), F.col("rows").cast("double").alias("value"))]
    items += [F.struct(F.lit(f"null_rate__{c}").alias("metric_name"),
                       F.round(F.col(f"n{i}") / F.col("rows"), 6).alias("value")) for i, c in enumerate(columns)]
    return g.select(F.lit(dataset).alias("dataset_path"), "run_timestamp",
                    F.date_format("run_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("run_id"),
                    F.explode(F.array(*items)).alias("m")).select("dataset_path", "run_id", "run_timestamp", "m.*")


def metrics_long(auto_metrics: DataFrame) -> DataFrame:
    """Auto-metrics rows -> long form.  ``column_profiles`` is parsed PERMISSIVE: a corrupt JSON
    value yields no null-rate rows for that run but keeps its ``rows_written``."""
    base = auto_metrics.select("dataset_path", "run_id", "run_timestamp", "rows_written", "column_profiles")
    rows = base.select("dataset_path", "run_id", "run_timestamp", F.lit("rows_written").alias("metric_name"),
                       F.col("rows_written").cast("double").alias("value"))
    prof = base.select("dataset_path", "run_id", "run_timestamp",
                       F.explode(F.from_json("column_profiles", PROFILE_JSON, {"mode": "PERMISSIVE"})).alias("p"))
    nulls = prof.filter(F.col("p.name").isNotNull()).select(
        "dataset_path", "run_id", "run_timestamp", F.concat(F.lit("null_rate__"), F.col("p.name")).alias("metric_name"),
        F.coalesce(F.col("p.null_rate"), F.lit(0.0)).alias("value"))
    return rows.unionByName(nulls)


def mean_last_runs(metrics: DataFrame, n: int = 7, include_current: bool = False, value: str = "value",
                   keys: tuple[str, ...] = ("dataset_path", "metric_name")) -> DataFrame:
    """Mean (and count) of the last ``n`` runs before each run."""
    w = Window.partitionBy(*keys).orderBy("run_timestamp", "run_id")
    frame = w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)
    return metrics.select("*", F.avg(value).over(frame).alias("hist_mean"),
                          F.count(value).over(frame).alias("hist_runs"))


def row_count_delta(metrics: DataFrame, max_drop_pct: float, lookback_runs: int = 7,
                    include_current: bool = False, name: str = "row_count_delta",
                    severity: str = "critical") -> DataFrame:
    """R5 per run: drop of ``rows_written`` against the mean of the previous runs.

    No history or a zero mean passes; the drop is floored at 0 and compared with ``<=``.
    """
    rows = metrics.filter(F.col("metric_name") == "rows_written")
    h = mean_last_runs(rows, lookback_runs, include_current)
    cur, mean = F.col("value"), F.col("hist_mean")
    no_base = (F.col("hist_runs") == 0) | mean.isNull() | (mean == 0)
    drop = F.greatest(F.lit(0.0), (mean - cur) / mean * 100)
    failed = ~no_base & (drop > F.lit(float(max_drop_pct)))
    r = result_struct(
        name, "row_count_delta", severity, F.when(failed, FAIL).otherwise(PASS),
        F.when(no_base, F.lit("no usable history: passes")).otherwise(
            F.format_string("row count %d against mean %.0f: drop %.1f%%", cur.cast("long"), mean, drop)),
        F.when(no_base, cur.cast("long").cast("string")).otherwise(F.concat(F.format_number(drop, 1), F.lit("%"))),
        F.when(no_base, F.lit(None)).otherwise(F.lit(f"<={float(max_drop_pct)}%")),
        F.when(failed, F.greatest(F.lit(0), (mean - cur).cast("long"))).otherwise(0))
    return h.select("dataset_path", "run_id", "run_timestamp", r.alias("r")).select(
        "dataset_path", "run_id", "run_timestamp", "r.*")


def run_delta(metrics: DataFrame) -> DataFrame:
    """Row-count delta and percent change against the previous run."""
    rows = metrics.filter(F.col("metric_name") == "rows_written")
    w = Window.partitionBy("dataset_path").orderBy("run_timestamp", "run_id")
    prev = F.lag("value").over(w)
    return rows.select("dataset_path", "run_id", "run_timestamp", F.col("value").alias("rows_written"),
                       prev.alias("prev_rows")).select(
        "*", (F.col("rows_written") - F.col("prev_rows")).alias("delta"),
        F.round((F.col("rows_written") - F.col("prev_rows")) * 100.0 / F.nullif(F.col("prev_rows"), F.lit(0.0)), 4)
        .alias("pct_change"))


def row_count_change(metrics: DataFrame, max_pct_change: float, name: str = "row_count_change",
                     severity: str = "critical") -> DataFrame:
    """R24 per run: two-sided change against the previous run; no previous run passes."""
    d = run_delta(metrics)
    change = F.abs(F.col("delta")) * 100.0 / F.col("prev_rows")
    no_base = F.col("prev_rows").isNull() | (F.col("prev_rows") == 0)
    failed = ~no_base & (change > F.lit(float(max_pct_change)))
    r = result_struct(
        name, "row_count_change", severity, F.when(failed, FAIL).otherwise(PASS),
        F.when(no_base, F.lit("no previous run: passes")).otherwise(
            F.format_string("row count changed %.1f%% against the previous run", change)),
        F.when(no_base, F.lit(None)).otherwise(F.concat(F.format_number(change, 1), F.lit("%"))),
        f"<={float(max_pct_change)}%",
        F.when(failed, F.abs(F.col("delta")).cast("long")).otherwise(0))
    return d.select("dataset_path", "run_id", "run_timestamp", r.alias("r")).select(
        "dataset_path", "run_id", "run_timestamp", "r.*")


def spc(metrics: DataFrame, days: int = 30, z: float = 3.0, min_runs: int = 7,
        include_current: bool = False) -> DataFrame:
    """Rolling ``days``-day mean and population stddev per metric, z-score and flag.

    Window: same dataset and metric, runs in ``[t - days, t)`` (or ``[t - days, t]`` with
    ``include_current``), over microseconds so sub-second times order correctly.  Fewer than
    ``min_runs`` points or a zero stddev -> no row.  Severity: critical above 1.5 x threshold,
    warning when flagged, info otherwise.
    """
    t = F.unix_micros(F.col("run_timestamp").cast("timestamp"))
    w = (Window.partitionBy("dataset_path", "metric_name").orderBy(t)
         .rangeBetween(-int(days) * MICROS_PER_DAY, 0 if include_current else -1))
    h = metrics.select("*", F.avg("value").over(w).alias("mean_30d"), F.stddev_pop("value").over(w).alias("stddev_30d"),
                       F.count("value").over(w).alias("points"))
    h = h.filter((F.col("points") >= min_runs) & (F.col("stddev_30d") > 0))
    zc = (F.col("value") - F.col("mean_30d")) / F.col("stddev_30d")
    h = h.withColumn("z_score", zc).withColumn("is_anomaly", F.abs(zc) > F.lit(float(z)))
    sev = (F.when(~F.col("is_anomaly"), F.lit("info"))
           .when(F.abs(F.col("z_score")) > F.lit(float(z) * 1.5), F.lit("critical")).otherwise(F.lit("warning")))
    msg = F.format_string("%s is %.4f, %.2f standard deviations from its %d-day mean %.4f (spread %.4f)",
                          "metric_name", "value", "z_score", F.lit(int(days)), "mean_30d", "stddev_30d")
    return h.select("run_id", "dataset_path", "run_timestamp", "metric_name", F.col("value").alias("current_value"),
                    "mean_30d", "stddev_30d", "z_score", "is_anomaly", sev.alias("severity"), msg.alias("message"))


def detect_anomalies(auto_metrics: DataFrame, settings: dict | None = None, include_current: bool = False) -> DataFrame:
    """Anomaly rows for row count and each column null rate from stored auto metrics."""
    s = settings or {}
    if s.get("enabled", True) is False:
        return spc(metrics_long(auto_metrics).filter(F.lit(False)))
    return spc(metrics_long(auto_metrics), days=int(s.get("lookback_days", 30)),
               z=float(s.get("z_score_threshold", 3.0)), include_current=include_current)
