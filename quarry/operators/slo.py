"""Service levels, metric bins, JSON logs and cost.

Metric points: ``TimeGenerated, Name, Val, Tags``; log lines: ``TimeGenerated, ClusterName,
Namespace, ContainerName, LogMessage`` (JSON text or plain text).  JSON fields are read with
``get_json_object`` which yields NULL on plain text, so bad lines are tolerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TS = "TimeGenerated"

# Burn-rate alert windows, thresholds and severities.
BURN_ALERTS = (("1 hour", 14.4, "critical"), ("6 hours", 3.0, "warning"))


def _bin(bin_: str, ts: str = TS) -> Column:
    return F.window(F.col(ts).cast("timestamp"), bin_).start.cast("timestamp_ntz")


def percentile_by_bin(points: DataFrame, q: float, bin_: str, value: str = "Val", exact: bool = False,
                      keys=()) -> DataFrame:
    """Percentile of a value per time bin.  Default: the bounded-memory sketch
    (``percentile_approx``); ``exact=True`` ranks the distinct values by their counts, so a bin
    is never held whole."""
    if exact:
        from .summary import exact_quantile

        return exact_quantile(points.withColumn("bin", _bin(bin_)), value, q, ["bin", *keys])
    agg = F.percentile_approx(value, F.lit(q), F.lit(10000))
    return points.groupBy(_bin(bin_).alias("bin"), *keys).agg(agg.alias(f"p{int(round(q * 100))}"))


def ratio_by_bin(points: DataFrame, good: Column, bin_: str, value: str = "Val", keys=()) -> DataFrame:
    """Good / total of a value per time bin (``sumif`` form)."""
    g = points.groupBy(_bin(bin_).alias("bin"), *keys).agg(
        F.sum(F.when(good, F.col(value)).otherwise(F.lit(0.0))).alias("good"), F.sum(value).alias("total"))
    return g.withColumn("ratio", F.col("good") / F.nullif(F.col("total"), F.lit(0.0)))


def counter_rate(points: DataFrame, keys, bin_: str, value: str = "Val") -> DataFrame:
    """Counter increase per second inside each bin.

    The increase is the sum of the steps up between neighbouring points of a series in the bin;
    after a reset the new value counts in full.
    """
    secs, keys = _bin_seconds(bin_), [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy("bin", *keys).orderBy(TS, value)
    prev = F.lag(value).over(w)
    step = F.when(prev.isNull(), F.lit(0.0)).when(F.col(value) >= prev, F.col(value) - prev).otherwise(F.col(value))
    return (points.withColumn("bin", _bin(bin_)).withColumn("__step", step)
            .groupBy("bin", *keys).agg((F.sum("__step") / F.lit(float(secs))).alias("rate_per_s")))


def _bin_seconds(bin_: str) -> int:
    n, unit = bin_.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(n) * mult[unit.rstrip("s")]


def service_level(points: DataFrame, good: Column, target: float, windows=BURN_ALERTS, value: str = "Val") -> DataFrame:
    """O1: per window length and bin: SLI, error budget, burn rate and alert.

    burn = (1 - SLI) / (1 - target); alert when burn is above the window's threshold
    (fast: 14.4 over 1 hour, slow: 3 over 6 hours).  One scan: good / total are summed per
    finest window (partial aggregation), and coarser windows are rolled up from those bins.
    """
    finest = min(windows, key=lambda w: _bin_seconds(w[0]))[0]
    for w, _, _ in windows:
        if _bin_seconds(w) % _bin_seconds(finest):
            raise ValueError("window lengths must be multiples of the finest one")
    base = ratio_by_bin(points, good, finest, value).select("bin", "good", "total")
    # each finest bin joins every window length it rolls up into (no self-union: one scan)
    per_window = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(float(th)).alias("threshold"),
                                     F.lit(sev).alias("sev"),
                                     (F.col("bin") if w == finest else _bin(w, "bin")).alias("wbin"))
                           for w, th, sev in windows])
    rolled = (base.select("good", "total", F.explode(per_window).alias("x"))
              .groupBy("x.window", "x.threshold", "x.sev", F.col("x.wbin").alias("bin"))
              .agg(F.sum("good").alias("good"), F.sum("total").alias("total")))
    budget = 1.0 - float(target)
    sli = F.col("good") / F.nullif(F.col("total"), F.lit(0.0))
    burn = (F.lit(1.0) - sli) / F.lit(budget)
    return rolled.select("window", "bin", "good", "total", sli.alias("sli"), F.lit(budget).alias("error_budget"),
                         burn.alias("burn_rate"), (burn > F.col("threshold")).alias("alert"),
                         F.when(burn > F.col("threshold"), F.col("sev")).alias("severity"))


def freshness_share(datasets: DataFrame, limits: DataFrame, as_of, key: str = "dataset") -> DataFrame:
    """O2: share of datasets whose last update is within their limit at ``as_of``."""
    a = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    age_h = (F.unix_micros(a.cast("timestamp")) - F.unix_micros(F.col("last_updated").cast("timestamp"))) / F.lit(3.6e9)
    j = datasets.join(limits, key)
    return j.agg(F.count(F.lit(1)).alias("datasets"),
                 F.count_if(age_h <= F.col("max_age_hours")).alias("fresh"),
                 F.avg(F.when(age_h <= F.col("max_age_hours"), 1.0).otherwise(0.0)).alias("fresh_share"))


def json_field(msg: str, field: str) -> Column:
    return F.get_json_object(F.col(msg), f"$.{field}")


def trace(logs: DataFrame, id_value: str, field: str = "pipeline_id", msg: str = "LogMessage") -> DataFrame:
    """O3: every log line of one id across components, in time order."""
    return (logs.filter(json_field(msg, field) == F.lit(id_value))
            .select(TS, "ClusterName", "Namespace", "ContainerName", json_field(msg, "level").alias("level"),
                    json_field(msg, "message").alias("message"))
            .orderBy(TS, "Namespace", "ContainerName", "message"))


def server_errors(logs: DataFrame, since, msg: str = "LogMessage", field: str = "status_code") -> DataFrame:
    """Lines whose JSON status code is 5xx since a time."""
    s = since if isinstance(since, Column) else F.lit(since).cast("timestamp_ntz")
    code = json_field(msg, field).cast("int")
    return logs.filter((F.col(TS) > s) & (code >= 500)).select(
        TS, json_field(msg, "method").alias("method"), json_field(msg, "path").alias("path"),
        json_field(msg, field).alias("status_code"), json_field(msg, "error").alias("error"))


def log_failures(logs: DataFrame, text: str, field: str = "dataset", msg: str = "LogMessage") -> DataFrame:
    """Count of lines containing ``text`` by a JSON field (non-empty)."""
    v = json_field(msg, field)
    return (logs.filter(F.col(msg).contains(text)).filter(v.isNotNull() & (v != ""))
            .groupBy(v.alias(field)).agg(F.count(F.lit(1)).alias("count")))


def cost_by(usage: DataFrame, dimension: str, k: int | None = None, cost: str = "Cost",
            default: str = "untagged") -> DataFrame:
    """Cost by a dimension (NULL -> ``untagged``), rounded to cents, optionally top ``k``."""
    g = usage.groupBy(F.coalesce(F.col(dimension), F.lit(default)).alias(dimension)).agg(
        F.round(F.sum(cost), 2).alias("cost"))
    if k is not None:
        g = g.orderBy(F.col("cost").desc(), F.col(dimension)).limit(k)
    return g


def run_cost(runs: DataFrame, prices: DataFrame, key: str = "node_type") -> DataFrame:
    """Run cost = driver hours x driver price + executor hours x executors x executor price."""
    j = runs.join(prices, key, "left")
    cost = (F.col("driver_seconds") * F.col("driver_price_per_hour")
            + F.col("executor_seconds") * F.col("executors") * F.col("executor_price_per_hour")) / 3600.0
    return j.withColumn("cost", F.round(cost, 4))
