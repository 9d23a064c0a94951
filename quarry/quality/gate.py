"""R17 gate, A22/A23 facets, R21 layer gates.

All of these aggregate rule-result rows (a handful per run).  Only ``gate`` reads one summary
row back to the driver to decide whether to raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .results import FAIL, PASS, WARN


class QualityGateError(RuntimeError):
    def __init__(self, failures: list[str]):
        super().__init__(f"critical quality rule(s) failed: {', '.join(failures)}")
        self.failures = failures


def _is_crit_fail() -> Column:
    return (F.col("status") == FAIL) & (F.lower(F.col("severity")) == "critical")


def run_status(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Overall status per run: FAIL if any FAIL, else WARN if any WARN, else PASS.

    Also the sorted list of critical failures, counts by status and the newest time.
    """
    keys = keys or []
    agg = [
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(F.col("status") == PASS).alias("passes"),
        F.count_if(F.col("status") == FAIL).alias("fails"),
        F.count_if(F.col("status") == WARN).alias("warnings"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
        F.sort_array(F.collect_list(F.when(_is_crit_fail(), F.col("rule_name")))).alias("critical_failures"),
    ]
    if "run_timestamp" in results.columns:
        agg.append(F.max("run_timestamp").alias("run_at"))
    g = results.groupBy(*keys).agg(*agg) if keys else results.agg(*agg)
    return g.withColumn(
        "overall_status",
        F.when(F.col("fails") > 0, F.lit(FAIL)).when(F.col("warnings") > 0, F.lit(WARN)).otherwise(F.lit(PASS)),
    )


def gate(results: DataFrame, fail_on_critical: bool = True) -> dict:
    """Decide the run: read the one summary row; raise on a critical FAIL when asked.

    Call it only after the results are stored, so a failing run still leaves its rows.
    """
    row = run_status(results).first()
    out = row.asDict(recursive=True)
    if fail_on_critical and out["critical_failures"]:
        raise QualityGateError(list(out["critical_failures"]))
    return out


def quality_facet(results: DataFrame, rows_written: DataFrame | None = None) -> DataFrame:
    """Facet payload as one JSON row.  Facet status is FAIL only on a critical failure.

    Fixed values: the payload keys."""
    s = results.agg(
        F.count(F.lit(1)).alias("rules_total"),
        F.count_if(F.col("status") == PASS).alias("rules_passed"),
        F.count_if(F.col("status") == FAIL).alias("rules_failed"),
        F.count_if(F.col("status") == WARN).alias("rules_warned"),
        F.sort_array(F.collect_list(F.when(_is_crit_fail(), F.col("rule_name")))).alias("critical_failures"),
    ).withColumn("overall_status", F.when(F.size("critical_failures") > 0, F.lit(FAIL)).otherwise(F.lit(PASS)))
    if rows_written is not None:
        # both sides are single rows; tag and aggregate instead of joining
        rw = rows_written.select(F.col("rows_written").cast("long").alias("rows_written"))
        s = (s.select("*", F.lit(None).cast("long").alias("rows_written"))
             .unionByName(rw, allowMissingColumns=True)
             .agg(*[F.max(c).alias(c) for c in ["rules_total", "rules_passed", "rules_failed", "rules_warned",
                                                 "overall_status", "rows_written"]],
                  F.max("critical_failures").alias("critical_failures")))
    else:
        s = s.withColumn("rows_written", F.lit(0).cast("long"))
    cols = ["rows_written", "rules_total", "rules_passed", "rules_failed", "rules_warned",
            "critical_failures", "overall_status"]
    return s.select(*cols, F.to_json(F.struct(*cols)).alias("facet_json"))


def quality_facet_v1(results: DataFrame) -> DataFrame:
    """Documented facet form: PASSED / WARNING / FAILED, counts by severity, failing rules.

    Fixed values: the payload keys."""
    failed = F.col("status").isin(FAIL, WARN)
    sev = F.lower(F.col("severity"))
    s = results.agg(
        F.count(F.lit(1)).alias("totalRules"),
        F.count_if(F.col("status") == PASS).alias("passedRules"),
        F.count_if(failed).alias("failedRules"),
        F.count_if(failed & (sev == "critical")).alias("criticalFailures"),
        F.count_if(failed & (sev == "warning")).alias("warningFailures"),
        F.sort_array(F.collect_list(F.when(failed, F.struct(
            F.col("rule_name").alias("ruleId"),
            F.coalesce(F.col("check_family"), F.lit("content")).alias("checkType"),
            F.upper(F.col("severity")).alias("severity"),
            F.col("actual_value").alias("observedValue"),
            F.col("expected_value").alias("threshold"),
            F.col("message").alias("message"))))).alias("failingRules"),
    )
    status = (F.when(F.col("criticalFailures") > 0, F.lit("FAILED"))
              .when(F.col("warningFailures") > 0, F.lit("WARNING")).otherwise(F.lit("PASSED")))
    s = s.withColumn("overallStatus", status).withColumn("passed", F.col("criticalFailures") == 0)
    return s.select("*", F.to_json(F.struct(
        "passed", "overallStatus",
        F.struct("totalRules", "passedRules", "failedRules", "criticalFailures", "warningFailures").alias("summary"),
        F.when(F.size("failingRules") > 0, F.col("failingRules")).alias("failingRules"))).alias("facet_json"))


# Rule types whose failure blocks a layer (hard gate); every other failing rule
# only alerts (soft gate).  Silver: null key, duplicate key, type / schema drift.  Gold: duplicate
# key, schema drift.  Bronze: schema drift is reported, nothing blocks.
HARD_GATES = {
    "bronze": (),
    "silver": ("schema", "not_null", "unique_key", "uniqueness"),
    "gold": ("schema", "unique_key", "uniqueness"),
}


def layer_gate(results: DataFrame, layer: str) -> DataFrame:
    """Per result, whether its failure blocks the layer (hard) or only alerts (soft)."""
    hard = HARD_GATES.get(layer, HARD_GATES["silver"])
    failed = F.col("status").isin(FAIL, WARN)
    is_hard = F.col("rule_type").isin(*hard) if hard else F.lit(False)
    return results.withColumn(
        "gate", F.when(~failed, F.lit("open")).when(is_hard, F.lit("hard")).otherwise(F.lit("soft"))
    ).withColumn("blocks", F.col("gate") == "hard")
