"""Quality run of a dataset slot (R18), tracking decorator (F4), imperative check (F5) and
custom metrics (F3).

Per run: one shared aggregation yields the row count, the profile and every fused rule; keyed
rules add one shuffle each; the three quality tables are appended; anomalies come from a
window over the stored metrics; the gate decides last.
"""

from __future__ import annotations

import functools
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..quality import engine
from ..quality.gate import gate
from ..quality.history import detect_anomalies
from ..quality.profile import profiles_json
from ..quality.results import AUTO_METRICS_SCHEMA
from ..quality.rules import Rule, RuleSet, RunContext, load_rules
from ..session import scratch_path
from ..sinks import writers as W
from ..sources.readers import read_slot


class CustomMetric(Rule):
    """a user function ``fn(df) -> DataFrame(metric_name, value, passed, message, severity)``
    whose rows become rule results (one per metric row)."""

    rule_type = "custom_metric"
    fused = False

    def __init__(self, name: str, fn: Callable[[DataFrame], DataFrame], severity: str = "warning"):
        super().__init__(name, severity)
        self.fn = fn

    def evaluate(self, df, ctx):
        m = self.fn(df)
        name = (F.concat(F.lit(self.name + ":"), F.col("metric_name").cast("string")) if "metric_name" in m.columns
                else F.lit(self.name))
        sev = F.lower(F.col("severity")) if "severity" in m.columns else F.lit(self.severity)
        msg = F.col("message") if "message" in m.columns else F.lit("")
        status = F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit(self.fail_status(ctx)))
        return m.select(name.alias("rule_name"), F.lit(self.rule_type).alias("rule_type"), sev.alias("severity"),
                        status.alias("status"), msg.cast("string").alias("message"),
                        F.col("value").cast("string").alias("actual_value"), F.lit(None).cast("string").alias("expected_value"),
                        F.lit(0).cast("long").alias("affected_rows"), F.lit("content").alias("check_family"))


@dataclass
class QualityTables:
    base: str

    def paths(self, dataset: str) -> dict:
        return {k: W.dq_table(dataset, k, self.base)[0] for k in ("auto", "rules", "anomaly")}


def run_quality(spark: SparkSession, df: DataFrame, dataset: str, rules: list[Rule] | RuleSet,
                tables: QualityTables, run_id: str | None = None, pipeline_name: str | None = None,
                run_timestamp: datetime | None = None, fail_on_critical: bool = True,
                anomaly: dict | None = None, warn_on_warning: bool = False, environment: str | None = None,
                write_duration_ms: int | None = None) -> dict:
    """Profile + rules in one pass, append the three tables, anomalies, gate.

    ``write_duration_ms`` is the caller's write time; without it, the time of this evaluation.
    """
    if isinstance(rules, RuleSet):
        anomaly = anomaly if anomaly is not None else rules.anomaly
        rules = rules.rules
    run_id = run_id or uuid.uuid4().hex
    ts = run_timestamp or datetime.now(timezone.utc).replace(tzinfo=None)
    paths = tables.paths(dataset)
    history = None
    if W.path_exists(spark, paths["auto"]):
        history = W.read_results(spark, paths["auto"]).filter(F.col("dataset_path") == dataset)
    ctx = RunContext(spark, as_of=ts, history=history, warn_on_warning=warn_on_warning)
    started = time.monotonic()
    # everything is computed before the first append, so a broken rule costs only its own row
    ev = engine.evaluate_resilient(df, rules, ctx, with_profile=True)
    prof = profiles_json(ev.profile)
    auto = prof.select(
        F.lit(run_id).alias("run_id"), F.lit(pipeline_name).cast("string").alias("pipeline_name"),
        F.lit(dataset).alias("dataset_path"), F.lit(environment).cast("string").alias("environment"),
        F.lit(ts).cast("timestamp").alias("run_timestamp"), F.col("rows_written").cast("long"),
        F.lit(df.schema.json()).alias("schema_json"), "column_profiles",
        F.lit(int((time.monotonic() - started) * 1000) if write_duration_ms is None else write_duration_ms)
        .cast("long").alias("write_duration_ms"))
    W.append_results(auto.select(*[f.name for f in AUTO_METRICS_SCHEMA.fields]), paths["auto"])
    results = engine.with_run_columns(ev.results, run_id, dataset, F.lit(ts).cast("timestamp"), pipeline_name)
    W.append_results(results, paths["rules"])
    settings = anomaly or {}
    if settings.get("enabled", True):
        allm = W.read_results(spark, paths["auto"]).filter(F.col("dataset_path") == dataset)
        an = detect_anomalies(allm, settings).filter(F.col("run_id") == run_id)
        W.append_results(an, paths["anomaly"])
    stored = W.read_results(spark, paths["rules"]).filter(F.col("run_id") == run_id)
    return gate(stored, fail_on_critical)


def gate_slot(spark: SparkSession, table: str, layer: str, slot: datetime, rules, tables: QualityTables,
              dataset: str | None = None, **kw) -> dict:
    """Filter one slot of a table (partition pruning), run the quality run on it."""
    df = read_slot(spark.table(table), layer, slot)
    return run_quality(spark, df, dataset or table.replace(".", "/"), rules, tables, **kw)


def check(df: DataFrame, dataset: str, rules, spark: SparkSession | None = None, **kw) -> DataFrame:
    """imperative form: rule-result rows for a DataFrame (lazy, nothing written)."""
    rs = load_rules(rules) if isinstance(rules, (str, dict)) else rules
    rule_list = rs.rules if isinstance(rs, RuleSet) else rs
    return engine.evaluate(df, rule_list, RunContext(spark or df.sparkSession, **kw))


def track(dataset: str, rules=None, pipeline_name: str | None = None, tables: QualityTables | None = None,
          fail_on_critical: bool = True, materialise: bool = True, environment: str | None = None):
    """decorator for ``fn(...) -> DataFrame``: runs the quality run on the returned frame.

    The frame is written once to the shared scratch folder, so the check and the caller's write
    share one computation and nothing stays pinned on executors; ``materialise=False`` leaves it
    lazy."""

    def deco(fn):
        name = pipeline_name or fn.__name__

        @functools.wraps(fn)
        def wrapper(*args, **kwargs):
            df = fn(*args, **kwargs)
            spent = None
            if materialise:
                started = time.monotonic()
                path = scratch_path(df.sparkSession, "track")
                df.write.parquet(path)
                df = df.sparkSession.read.schema(df.schema).parquet(path)
                spent = int((time.monotonic() - started) * 1000)
            rs = load_rules(rules) if isinstance(rules, (str, dict)) else (rules or [])
            if tables is None:
                rl = rs.rules if isinstance(rs, RuleSet) else rs
                res = engine.evaluate_resilient(df, rl, RunContext(df.sparkSession)).results
                wrapper.last_report = gate(res, fail_on_critical)
            else:
                wrapper.last_report = run_quality(df.sparkSession, df, dataset, rs, tables, pipeline_name=name,
                                                  fail_on_critical=fail_on_critical, environment=environment,
                                                  write_duration_ms=spent)
            return df

        wrapper.last_report = None
        return wrapper

    return deco
