"""R17 core: evaluate a rule list on a DataFrame with one shared scan.

Plan shape (per run):

* one ``agg`` holds the row count, every fused rule's aggregates and (optionally) the profile;
  Spark runs it as partial aggregation on each task plus a single-row final merge;
* each keyed rule adds one ``groupBy`` on its key (partial aggregation first, so a hot key
  collapses to one row per task before the shuffle);
* history rules read the same one-row aggregate (checkpointed once) and the metrics history,
  which has one row per earlier run.

Results are a lazy union: nothing is collected here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import profile as prof
from .results import RESULT_COLUMNS, RULE_RESULT_FIELDS, SKIPPED
from .rules import Rule, RunContext


def first_line(exc: Exception) -> str:
    """The whole first line of an error's text."""
    return (str(exc).splitlines() or [type(exc).__name__])[0]


def _skipped(ctx: RunContext, rule: Rule, exc: Exception) -> DataFrame:
    row = (rule.name, rule.rule_type, rule.severity, SKIPPED,
           f"rule could not be evaluated: {first_line(exc)}", None, None, 0,
           "content")
    return ctx.spark.createDataFrame([row], RULE_RESULT_FIELDS)


@dataclass
class Evaluation:
    aggregate: DataFrame      # the one-row aggregate (count, rule sums, profile stats)
    results: DataFrame        # rule-result rows
    profile: DataFrame | None  # long profile, when asked for


def evaluate_all(df: DataFrame, rules: list[Rule], ctx: RunContext, with_profile: bool = False,
                 exact_distinct: bool = False, materialise: bool = False) -> Evaluation:
    """One keyless aggregation for all row rules (and the profile), one key-only pass per keyed
    rule.  ``materialise`` checkpoints the aggregate row, so everything read from it scans once."""
    usable: list[tuple[int, Rule]] = []
    skipped: list[DataFrame] = []
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, r in enumerate(r for r in rules if r.fused):
        try:
            exprs = r.aggs(f"r{i}", ctx)
            if exprs:
                df.agg(*exprs).schema  # analysis only
            aggs.extend(exprs)
            usable.append((i, r))
        except (AnalysisException, ValueError) as exc:
            skipped.append(_skipped(ctx, r, exc))
    fields = list(df.schema.fields)
    if with_profile:
        aggs.extend(prof.profile_aggs(fields, exact_distinct))
    row = df.agg(*aggs)
    if with_profile and exact_distinct:
        row = prof.with_exact_distinct(row, df, fields)
    if materialise or any(getattr(r, "needs_rows", False) for r in rules if not r.fused):
        row = cut_lineage(row)
    parts: list[DataFrame] = []
    if usable:
        structs = [r.result(f"r{i}", ctx) for i, r in usable]
        parts.append(row.select(F.explode(F.array(*structs)).alias("r")).select("r.*"))
    for r in rules:
        if r.fused:
            continue
        try:
            parts.append(r.from_rows(row, ctx) if getattr(r, "needs_rows", False) else r.evaluate(df, ctx))
        except (AnalysisException, ValueError, KeyError) as exc:
            parts.append(_skipped(ctx, r, exc))
    parts.extend(skipped)
    results = parts[0] if parts else _empty_results(ctx)
    for p in parts[1:]:
        results = results.unionByName(p)
    profile_df = None
    if with_profile:
        profile_df = (row.select(F.col("__rows").alias("rows"), F.explode(prof.profile_rows(fields)).alias("c"))
                      .select(*[F.col(f"c.{n}").alias(n) for n in prof.PROFILE_COLUMNS], "rows"))
    return Evaluation(row, results, profile_df)


def evaluate(df: DataFrame, rules: list[Rule], ctx: RunContext | None = None, **kw) -> DataFrame:
    """Rule-result rows for ``rules`` on ``df`` (lazy)."""
    ctx = ctx or RunContext(df.sparkSession, **kw)
    return evaluate_all(df, rules, ctx).results


def _empty_results(ctx: RunContext) -> DataFrame:
    return ctx.spark.createDataFrame([], RULE_RESULT_FIELDS)


def with_run_columns(results: DataFrame, run_id: str, dataset_path: str, run_timestamp,
                     pipeline_name: str | None = None) -> DataFrame:
    """Prefix rule results with the run columns of the rule-results table (schema order)."""
    ts = run_timestamp if not isinstance(run_timestamp, str) else F.lit(run_timestamp).cast("timestamp")
    ts = ts if hasattr(ts, "alias") else F.lit(ts).cast("timestamp")
    return results.select(
        F.lit(run_id).alias("run_id"),
        F.lit(pipeline_name).cast("string").alias("pipeline_name"),
        F.lit(dataset_path).alias("dataset_path"),
        ts.cast("timestamp").alias("run_timestamp"),
        *RESULT_COLUMNS,
    )


def evaluate_by(df: DataFrame, rules: list[Rule], keys: list[str], ctx: RunContext | None = None) -> DataFrame:
    """Rule results for every group of ``keys`` (e.g. every partition slot) in one pass.

    Fused rules become one grouped aggregation (partial aggregation per task, one shuffle on
    ``keys``); keyed rules group by ``keys`` plus their own key, reading only those columns.
    Rules that need run history are evaluated per run by the history operators instead and are
    rejected here.
    """
    ctx = ctx or RunContext(df.sparkSession)
    fused = [(i, r) for i, r in enumerate(rules) if r.fused]
    parts: list[DataFrame] = []
    if fused:
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for i, r in fused:
            aggs.extend(r.aggs(f"r{i}", ctx))
        row = df.groupBy(*keys).agg(*aggs)
        structs = [r.result(f"r{i}", ctx) for i, r in fused]
        parts.append(row.select(*keys, F.explode(F.array(*structs)).alias("r")).select(*keys, "r.*"))
    for r in rules:
        if r.fused:
            continue
        if not hasattr(r, "evaluate_by"):
            raise ValueError(f"rule type {r.rule_type!r} cannot be evaluated per group")
        parts.append(r.evaluate_by(df, keys, ctx))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_errors() -> tuple:
    """What a job that fails while running raises on the driver."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    return PySparkException, Py4JJavaError


def evaluate_resilient(df: DataFrame, rules: list[Rule], ctx: RunContext, with_profile: bool = False) -> Evaluation:
    """``evaluate_all``, materialised (reliable checkpoints), where a rule that fails while
    running becomes a SKIPPED row instead of failing the run.

    The happy path is one shared job and one per keyed rule.  Only when that fails is each rule
    run alone to find those that break; the rest then run together again.
    """
    def settled(kept: list[Rule]) -> Evaluation:
        ev = evaluate_all(df, kept, ctx, with_profile, materialise=True)
        return Evaluation(ev.aggregate, cut_lineage(ev.results), ev.profile)

    try:
        return settled(rules)
    except run_errors():
        kept, broken = [], []
        for r in rules:
            try:
                cut_lineage(evaluate(df, [r], ctx))
                kept.append(r)
            except run_errors() as exc:
                broken.append(_skipped(ctx, r, exc))
        ev = settled(kept)
        for b in broken:
            ev.results = ev.results.unionByName(b)
        return ev
