"""W2, R19 without rereading thirty days of runs: moments per day, merged over the window.

A day's row holds the number of runs of a metric, their mean, and the sum of squared differences from it.  The window of a
run, ``[t - days, t)``, is made of whole days, taken from those rows, and of two parts of days, taken from the runs
themselves: at most ``days`` rows and two days of runs for each new run, whatever the number of runs in a day.
Merging shifts by the run's own value, so the variance loses no digits to large means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["dataset_path", "metric_name"]


def day_moments(metrics: DataFrame) -> DataFrame:
    """(dataset_path, metric_name, day, n, mean, m2) of runs (``run_timestamp``, ``value``)."""
    v = F.col("value")
    return metrics.filter(v.isNotNull()).groupBy(*KEYS, F.to_date("run_timestamp").alias("day")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_days(moments: DataFrame, by) -> DataFrame:
    """Moments of several days as one row per group of ``by``."""
    near = moments.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__c"))
    d = F.col("mean") - F.col("__c")
    sums = moments.join(near, list(by)).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("__s"), F.sum(F.col("m2") + F.col("n") * d * d).alias("m2"))
    return sums.select(*by, "n", (F.col("__s") / F.col("n")).alias("mean"), "m2")


def spc_of_days(new_runs: DataFrame, moments: DataFrame, metrics: DataFrame, days: int = 30, z: float = 3.0, min_runs: int = 7) -> DataFrame:
    """z-scores of ``new_runs`` against the ``days`` days before each, equal to those of ``history.spc``.

    ``moments`` are stored day rows; of ``metrics`` only the first and last day of each window are read.
    """
    t = F.col("run_timestamp")
    now = new_runs.select(*[F.col(c).alias(f"__{c}") for c in KEYS], "run_id", F.col("value").alias("current_value"), t.alias("__t"),
                          (t - F.expr(f"INTERVAL {int(days)} DAYS")).alias("__from")) \
        .withColumns({"__last": F.to_date("__t"), "__first": F.to_date("__from")})
    mine = (F.col("dataset_path") == F.col("__dataset_path")) & (F.col("metric_name") == F.col("__metric_name"))
    whole = now.join(moments, mine & (F.col("day") > F.col("__first")) & (F.col("day") < F.col("__last")))
    runs = metrics.select(*KEYS, t.alias("run_at"), "value", F.to_date("run_timestamp").alias("day")).filter(F.col("value").isNotNull())
    edges = now.withColumn("__day", F.explode(F.array_distinct(F.array("__first", "__last"))))
    part = edges.join(runs, mine & (F.col("day") == F.col("__day")) & (F.col("run_at") >= F.col("__from")) & (F.col("run_at") < F.col("__t")))
    cols = ["run_id", "__dataset_path", "__metric_name", "__t", "current_value"]
    every = whole.select(*cols, "n", "mean", "m2").unionByName(
        part.select(*cols, F.lit(1).cast("long").alias("n"), F.col("value").alias("mean"), F.lit(0.0).alias("m2")))
    d = F.col("mean") - F.col("current_value")
    g = every.groupBy(*cols).agg(F.sum("n").alias("points"), F.sum(F.col("n") * d).alias("s1"), F.sum(F.col("m2") + F.col("n") * d * d).alias("s2"))
    off = F.col("s1") / F.col("points")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("points") - off * off))
    g = g.select(F.col("run_id"), F.col("__dataset_path").alias("dataset_path"), F.col("__metric_name").alias("metric_name"),
                 F.col("__t").alias("run_timestamp"), "current_value", "points", (F.col("current_value") + off).alias("mean_30d"),
                 spread.alias("stddev_30d")).filter((F.col("points") >= min_runs) & (F.col("stddev_30d") > 0))
    score = (F.col("current_value") - F.col("mean_30d")) / F.col("stddev_30d")
    return g.withColumn("z_score", score).withColumn("is_anomaly", F.abs(score) > F.lit(float(z)))
