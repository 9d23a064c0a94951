"""Quality-result summaries and general aggregations.

Every operator is a ``groupBy``/``agg`` plan: partial aggregation on each task, one shuffle on
the grouping key.  Order-sensitive picks use ``max_by`` with a full tie-break, which also
aggregates partially, instead of a window that would pull a whole group into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

FAIL, WARN, PASS = "FAIL", "WARN", "PASS"


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def row_count(df: DataFrame) -> DataFrame:
    """A3: global count as one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """A4: number of distinct key rows (NULL is a value, as in DISTINCT)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def run_flags(rule_results: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Per run: its newest time, and whether any rule blocked it or warned."""
    blocked = (F.col("status") == FAIL) & (F.lower("severity") == "critical")
    return rule_results.groupBy(dataset_col, "run_id").agg(
        F.max("run_timestamp").alias("seen_at"), F.bool_or(blocked).alias("blocked"),
        F.bool_or(F.col("status") == WARN).alias("warned"))


def summary_by_rules(rule_results: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """A5: run -> dataset summary from rule-result rows (two-level aggregation).

    A run is clean when nothing blocked it and nothing warned.  The last status is that of the
    newest run (ties broken by run id).  Output columns are fixed.
    """
    clean = ~F.col("blocked") & ~F.col("warned")
    outcome = F.when(clean, F.lit(PASS)).when(F.col("blocked"), F.lit(FAIL)).otherwise(F.lit(WARN))
    return run_flags(rule_results, dataset_col).groupBy(F.col(dataset_col).alias("dataset")).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.round(F.avg(clean.cast("double")), 4).alias("pass_rate"),
        F.max("seen_at").alias("last_run_at"),
        F.count_if(F.col("blocked")).alias("critical_failures"),
        F.count_if(F.col("warned")).alias("warnings"),
        F.max_by(outcome, F.struct("seen_at", "run_id")).alias("last_status"))


def summary_by_runs(run_summaries: DataFrame) -> DataFrame:
    """Dataset summary from run-summary rows (counts ``overall_status='PASS'``)."""
    g = run_summaries.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.sum(F.when(F.col("overall_status") == PASS, 1).otherwise(0)).alias("passes"),
        F.sum(F.when(F.col("critical_failures") != "", 1).otherwise(0)).alias("critical_failures"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
        F.max("run_at").alias("last_run_at"),
        F.max_by("overall_status", F.struct("run_at", "run_id")).alias("last_status"),
    )
    return g.select(
        "dataset", "total_runs",
        F.when(F.col("total_runs") > 0, F.round(F.col("passes") / F.col("total_runs"), 4)).otherwise(0.0).alias("pass_rate"),
        "last_run_at", F.col("critical_failures").cast("long").alias("critical_failures"),
        F.col("warnings").cast("long").alias("warnings"), F.coalesce("last_status", F.lit(PASS)).alias("last_status"))


def monitored_only(metrics: DataFrame, summaries: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Datasets that have profiles but no rule results, shown as MONITORED."""
    prof = metrics.groupBy(F.col(dataset_col).alias("dataset")).agg(
        F.count(F.lit(1)).alias("total_runs"), F.max("run_timestamp").alias("last_run_at"))
    rated = summaries.select("dataset").distinct()
    return prof.join(rated, "dataset", "left_anti").select(
        "dataset", "total_runs", F.lit(None).cast("double").alias("pass_rate"), "last_run_at",
        F.lit(0).cast("long").alias("critical_failures"), F.lit(0).cast("long").alias("warnings"),
        F.lit("MONITORED").alias("last_status"))


def dq_overview(rule_results: DataFrame, metrics: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Rules summary united with the monitored fallback."""
    s = summary_by_rules(rule_results, dataset_col)
    return s.unionByName(monitored_only(metrics, s, dataset_col))


def platform_quality(summaries: DataFrame) -> DataFrame:
    """Mean pass rate over rated datasets (percent, rounded), issue and status counts."""
    st = F.col("last_status")
    issue = (~st.isin(PASS, "MONITORED")) | (F.col("critical_failures") > 0)
    return summaries.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.round(F.avg("pass_rate") * 100).cast("long").alias("avg_pass_pct"),
        F.coalesce(F.avg("pass_rate"), F.lit(0.0)).alias("overall_pass_rate"),
        F.count_if(issue).alias("issues"),
        F.count_if(F.col("critical_failures") > 0).alias("critical_datasets"),
        F.count_if(st == PASS).alias("pass_count"),
        F.count_if(st == FAIL).alias("fail_count"),
        F.count_if(st == WARN).alias("warn_count"),
        F.count_if(st == "MONITORED").alias("monitored_count"),
    )


def pass_rate_trend(rule_results: DataFrame, days: int, as_of) -> DataFrame:
    """Share of passing rule rows per day over the last ``days`` days (percent, 2 dp)."""
    recent = rule_results.filter(F.col("run_timestamp") >= _ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(F.to_date("run_timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == PASS).alias("passed"),
        F.round(F.count_if(F.col("status") == PASS) * 100.0 / F.count(F.lit(1)), 2).alias("pass_pct"))


def worst_datasets(rule_results: DataFrame, days: int, k: int, as_of, dataset_col: str = "dataset") -> DataFrame:
    """A10: datasets with the lowest pass rate over ``days`` days; NULLIF guards empty counts."""
    recent = rule_results.filter(F.col("run_timestamp") >= _ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    g = recent.groupBy(F.col(dataset_col).alias("dataset")).agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == FAIL).alias("failures"),
        F.count_if(F.col("status") == PASS).alias("passes"))
    rate = F.round(F.col("passes") * 100.0 / F.nullif(F.col("checks"), F.lit(0)), 2)
    return g.withColumn("pass_pct", rate).orderBy(F.col("pass_pct").asc_nulls_last(), F.col("failures").desc(),
                                                  F.col("dataset")).limit(int(k))


def rule_failures(rule_results: DataFrame, days: int, as_of, dataset_col: str = "dataset") -> DataFrame:
    """Per rule, failure and warning counts with FILTER-style conditional counts."""
    recent = rule_results.filter(F.col("run_timestamp") >= _ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(F.col(dataset_col).alias("dataset"), "rule_name", "rule_type").agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.count_if(F.col("status") == FAIL).alias("failures"),
        F.count_if(F.col("status") == WARN).alias("warnings"),
        F.max(F.when(F.col("status") == FAIL, F.col("run_timestamp"))).alias("last_failure"))


def daily_volume(df: DataFrame, ts: str, amount: str, entity: str, where: Column | str | None = None) -> DataFrame:
    """Per day count, sum and exact distinct entities."""
    if where is not None:
        df = df.filter(where)
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(amount).alias("amount"),
        F.count_distinct(entity).alias("entities"))


def group_stats(df: DataFrame, keys: list[str], value: str, slot: Column | str | None = None) -> DataFrame:
    """Count and mean per group inside one slot."""
    if slot is not None:
        df = df.filter(slot)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))


def quantile_metric(df: DataFrame, col: str, q: float = 0.99, accuracy: int = 10000, keys=None) -> DataFrame:
    """Approximate quantile (P99 by default), optionally per group."""
    agg = F.percentile_approx(F.col(col), F.lit(q), F.lit(accuracy)).alias(f"p{int(round(q * 100))}")
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def exact_quantile(df: DataFrame, col: str, q: float = 0.99, keys=None) -> DataFrame:
    """Exact twin of A14 (linear interpolation, as SQL's ``percentile_cont``).

    Values are first counted (partial aggregation), spread over tasks by a range sort of
    (group, value), and ranked through running counts of each task plus the counts of earlier
    tasks; only the two values around the wanted rank of a group meet.  No task holds a group.
    """
    keys = list(keys or [])
    name = f"p{int(round(q * 100))}"
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    s = cut_lineage(counts.repartitionByRange(*[F.col(k) for k in keys], F.col("__v")).withColumn("__p", F.spark_partition_id()))
    per = s.groupBy(*keys, "__p").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("__off", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    total = offs.groupBy(*keys).agg(F.sum("__m").alias("__all"))
    offs = _null_join(offs.drop("__m"), total, keys)
    inside = Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = _null_join(s.withColumn("__run", F.sum("__n").over(inside)), offs, [*keys, "__p"])
    last = F.col("__off") + F.col("__run")            # 1-based rank of the value's last row
    first = last - F.col("__n")                        # 0-based rank of its first
    want = F.lit(float(q)) * (F.col("__all") - 1)
    near = r.filter((first <= F.ceil(want)) & (last - 1 >= F.floor(want)))
    frac = want - F.floor(want)
    g = near.withColumn("__frac", frac).groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.max("__frac").alias("__f"))
    return g.select(*keys, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias(name))


def _null_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join on ``keys`` with NULL equal to NULL; without keys the one row of ``right``."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(r, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]).drop(*[f"__r_{k}" for k in keys])


def last_updated(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Max of the first known time column from a name list (schema lookup, no scan)."""
    names = {f.name.lower(): f.name for f in df.schema.fields}
    for c in candidates:
        if c.lower() in names:
            col = names[c.lower()]
            return df.agg(F.lit(col).alias("column"), F.max(col).cast("timestamp").alias("last_updated"))
    return df.sparkSession.createDataFrame([(None, None)], "column string, last_updated timestamp")


def counts_by(df: DataFrame, key: str, flags: dict[str, Column] | None = None, values: list | None = None) -> DataFrame:
    """Count per key value plus conditional totals, in one aggregation.

    With ``values`` one row with a column per value (``count_if`` each, like a pivot with known
    values); without, one row per value found, so the number of values is unbounded.
    """
    totals = [F.count_if(c).alias(n) for n, c in (flags or {}).items()]
    if values is None:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *totals)
    per_value = [F.count_if(F.col(key) == F.lit(v)).alias(str(v)) for v in values]
    return df.agg(*per_value, F.count(F.lit(1)).alias("total"), *totals)


def union_results(dfs_by_dataset: dict[str, DataFrame]) -> DataFrame:
    """Union of many rule tables, each tagged with its dataset; missing columns are NULL."""
    parts = [d.withColumn("dataset", F.lit(name)) for name, d in dfs_by_dataset.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_names(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column."""
    return df.select(col).distinct()
