"""Window-style operators (W3, W4, W6) and sliding windows by running totals.

Picks of one row per key use ``row_number() = 1``: one shuffle on the key, with Spark's window
group limit keeping one row per key and task before it.  Ranks of all rows use a range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _order(order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def latest_per(df: DataFrame, keys, order, ascending: bool = False) -> DataFrame:
    """One row per key, the newest by ``order`` (all other columns break ties).

    One shuffle on the key and ``row_number``; Spark keeps only each task's best rows of a key
    before the shuffle (window group limit), so a hot key does not travel whole.
    """
    keys, order = _order(keys), _order(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    by = [F.col(c).asc() if ascending else F.col(c).desc() for c in order + rest]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def dedup(df: DataFrame, keys, order=None) -> DataFrame:
    """Keep one row per key.  With ``order`` the newest row wins (deterministic);
    without, ``dropDuplicates`` keeps an arbitrary one."""
    if order is None:
        return df.dropDuplicates(_order(keys))
    return latest_per(df, keys, order)


def runs_by_day(runs: DataFrame, day_of: Column | None = None, start: str = "start_date",
                logical: str = "logical_date", run_id: str = "dag_run_id") -> DataFrame:
    """Runs grouped by UTC day, newest first inside the day (``rank_in_day``); the day's
    state is the state of its most recently started run.

    The rank is computed without a window over the day (a busy day would land in one task):
    a range-partitioned sort spreads even a hot day over several tasks, each row gets its
    position inside its task, and a small table of per-(task, day) counts supplies the offset
    of earlier tasks.  The day state is a partial ``max_by`` aggregation.
    """
    day = day_of if day_of is not None else F.to_date(F.coalesce(F.col(logical), F.col(start)))
    started = F.coalesce(F.col(start), F.col(logical))
    base = runs.withColumn("day", day).withColumn("__started", started)
    order = [F.col("day").desc(), F.col("__started").desc(), F.col(run_id).desc()]
    ranked = rank_within(base, "day", order)
    day_state = base.groupBy("day").agg(F.max_by("state", F.struct("__started", F.col(run_id))).alias("day_state"),
                                        F.count(F.lit(1)).alias("runs_in_day"))
    # rows without a day are a group of their own
    state = day_state.withColumnRenamed("day", "__day")
    return ranked.join(state, F.col("day").eqNullSafe(F.col("__day"))).drop("__started", "__day")


def rank_within(df: DataFrame, group: str, order: list[Column], out: str = "rank_in_day") -> DataFrame:
    """Dense 1-based position of each row inside its group under ``order`` (no ties when the
    order is total), computed with a range-partitioned sort instead of a per-group window."""
    # the sorted frame is written once: positions and offsets must come from the same tasks
    s = cut_lineage(df.sort(*order).withColumn("__part", F.spark_partition_id())
                    .withColumn("__pos", F.monotonically_increasing_id()))
    firsts = s.groupBy("__part", group).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # rows of the group held by earlier tasks (a range sort keeps a group in consecutive tasks)
    w = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = firsts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    o = offsets.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), "__first", "__before")
    j = s.join(o, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return j.withColumn(out, (F.col("__pos") - F.col("__first") + F.col("__before") + 1).cast("int")) \
        .drop("__part", "__pos", "__first", "__before", "__p", "__g")


def sliding_totals(bins: DataFrame, at: str, values, spans: dict[str, int], slide: int) -> DataFrame:
    """Totals of every sliding window over time bins, without copying a bin into its windows.

    ``bins`` has one row per bin of ``slide`` seconds that holds rows (``at``: its start).  Each bin
    adds its values at the first window start that sees it and takes them back after the last one: two
    rows per bin and span, whatever the span.  A window's total is the running total of those changes at its
    start, the difference of two prefix sums.  Running totals are taken per day and carried over by the
    days' sums (one row per day), so no task holds the whole time line.

    Returns ``span`` (a key of ``spans``, whose values are seconds), ``window_start``, ``window_end`` and the
    values, for every window that holds a bin.
    """
    values = _order(values)
    step = F.make_dt_interval(secs=F.lit(slide))
    table = F.array(*[F.struct(F.lit(name).alias("span"), F.lit(secs).alias("secs")) for name, secs in spans.items()])
    wide = bins.select(F.col(at).alias("__at"), *values, F.explode(table).alias("__s"))
    change = lambda t, sign: F.struct(t.alias("t"), *[(F.col(v) * sign).alias(v) for v in values])
    enters = F.col("__at") - F.make_dt_interval(secs=F.col("__s.secs") - slide)
    changes = wide.select("__s.span", "__s.secs", F.explode(F.array(change(enters, 1), change(F.col("__at") + step, -1))).alias("__c")) \
        .groupBy("span", "secs", F.col("__c.t").alias("t")).agg(*[F.sum(f"__c.{v}").alias(v) for v in values]) \
        .withColumn("day", F.date_trunc("day", "t"))
    days = changes.groupBy("span", "day").agg(F.min("t").alias("__first"), *[F.sum(v).alias(f"__d_{v}") for v in values])
    past = Window.partitionBy("span").orderBy("day")
    carried = days.select("span", "day", F.lead("__first").over(past).alias("__next_day"), *[
        F.coalesce(F.sum(f"__d_{v}").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{v}") for v in values])
    inside = Window.partitionBy("span", "day").orderBy("t")
    running = changes.join(carried, ["span", "day"]).select(
        "span", "secs", "t", F.coalesce(F.lead("t").over(inside), "__next_day").alias("__until"),
        *[(F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"__b_{v}")).alias(v) for v in values])
    starts = F.explode(F.sequence("t", F.col("__until") - step, step)).alias("window_start")
    return running.filter(F.greatest(*[F.abs(F.col(v)) for v in values], F.lit(0)) > 0).select("span", starts, "secs", *values).select(
        "span", "window_start", (F.col("window_start") + F.make_dt_interval(secs=F.col("secs"))).alias("window_end"), *values)
