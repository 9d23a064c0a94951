"""R20 per-slot quality record and R22 valid / rejected row split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .rules import AcceptedValues, Expression, NotNull, Regex, Rule, ValueRange, _col, not_in, out_of_range


def slot_quality(df: DataFrame, slot: Column | str, keys: list[str], ts: str, critical_cols: list[str],
                 unique_key: list[str] | None = None, valid: Column | None = None,
                 expected_end: Column | None = None, dimension: str | None = None,
                 expected_schema=None) -> DataFrame:
    """One record per slot: volume, distinct keys, min/max event time and span, lag of the
    newest event behind the slot's expected end (minutes), NULL percent of critical columns,
    duplicate rows on the unique key, valid / invalid rows, counts by a key dimension, and
    whether the schema drifted from the contract (metadata, the same for every slot)."""
    slot_c = F.col(slot) if isinstance(slot, str) else slot
    n = F.count(F.lit(1))
    aggs = [n.alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts")]
    for c in critical_cols:
        aggs.append(F.round(F.count_if(F.col(c).isNull()) * 100.0 / n, 4).alias(f"null_pct_{c}"))
    if valid is not None:
        aggs.append(F.count_if(valid).alias("valid_rows"))
        aggs.append((n - F.count_if(valid)).alias("invalid_rows"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    aggs.append(F.round((micros(F.max(ts)) - micros(F.min(ts))) / F.lit(3_600_000_000.0), 4).alias("span_hours"))
    out = df.groupBy(slot_c.alias("slot")).agg(*aggs)
    out = _beside(out, _key_rows(df, slot_c, keys).select("slot", F.col("keys").alias("distinct_keys")))
    if unique_key:
        # a NULL key is a value, as in R6
        dup = _key_rows(df, slot_c, unique_key).select("slot", (F.col("n") - F.col("keys")).alias("duplicate_rows"))
        out = _beside(out, dup)
    if expected_end is not None:
        out = out.withColumn("lag_minutes", F.round((micros(expected_end) - micros(F.col("max_ts"))) / F.lit(60_000_000.0), 2))
    if dimension is not None:
        # counts by a low-cardinality key dimension: (slot, value) counts, then one map per slot
        d = df.groupBy(slot_c.alias("slot"), F.col(dimension).alias("d")).agg(n.alias("c"))
        d = d.groupBy("slot").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("d", "c")))).alias(
            f"counts_by_{dimension}"))
        out = _beside(out, d)
    if expected_schema is not None:
        from ..operators.setops import schema_diff

        drift = schema_diff(df.sparkSession, expected_schema, df.schema).filter(F.col("change") != "nullability")
        out = out.withColumn("schema_drift", F.lit(not drift.isEmpty()))
    return out


def _beside(out: DataFrame, more: DataFrame) -> DataFrame:
    """Joins per-slot columns; the NULL slot (rows without a time) is a slot of its own."""
    more = more.withColumnRenamed("slot", "__slot")
    return out.join(more, F.col("slot").eqNullSafe(F.col("__slot")), "left").drop("__slot")


def _key_rows(df: DataFrame, slot: Column, keys: list[str]) -> DataFrame:
    """Per slot: rows and distinct key rows, through one aggregation at (slot, key)."""
    per = df.groupBy(slot.alias("slot"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("slot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))


def row_failure(rule: Rule) -> Column:
    """Per-row failure predicate of a row rule (NULL outcome counts as pass)."""
    if isinstance(rule, NotNull):
        cond = None
        for c in rule.columns:
            e = _col(c).isNull()
            cond = e if cond is None else cond | e
        return cond
    if isinstance(rule, ValueRange):
        cond = out_of_range(_col(rule.column), rule.min, rule.max)
        return F.coalesce(cond, F.lit(False)) if cond is not None else F.lit(False)
    if isinstance(rule, AcceptedValues):
        return F.coalesce(not_in(_col(rule.column), rule.values), F.lit(False))
    if isinstance(rule, Regex):
        return F.coalesce(~_col(rule.column).rlike(rule.pattern), F.lit(False))
    if isinstance(rule, Expression):
        return F.coalesce(~F.expr(rule.expr), F.lit(False))
    raise ValueError(f"rule type {rule.rule_type!r} is not a row rule")


def tag_reasons(df: DataFrame, rules: list[Rule], out: str = "reasons") -> DataFrame:
    """Add an array of the names of the rules each row breaks (empty when valid)."""
    reasons = F.array_compact(F.array(*[F.when(row_failure(r), F.lit(r.name)) for r in rules]))
    return df.withColumn(out, reasons)


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``); every input row lands on one side.

    The tagged rows are written once (``write_split``), so the input is scanned once and each
    side reads its own partition."""
    path = scratch_path(df.sparkSession, "split")
    write_split(df, rules, path)
    tagged = tag_reasons(df, rules)
    spark, schema = df.sparkSession, tagged.withColumn("_side", F.lit("")).schema
    back = spark.read.schema(schema).parquet(path)
    return (back.filter("_side = 'valid'").drop("reasons", "_side"), back.filter("_side = 'rejected'").drop("_side"))


def write_split(df: DataFrame, rules: list[Rule], path: str, fmt: str = "parquet") -> None:
    """R22 sink: valid and rejected rows written by one job into one table partitioned by
    ``_side`` (``path/_side=valid`` and ``path/_side=rejected``, the latter with ``reasons``)."""
    side = F.when(F.size("reasons") == 0, F.lit("valid")).otherwise(F.lit("rejected"))
    tagged = tag_reasons(df, rules).withColumn("_side", side)
    tagged.write.mode("overwrite").format(fmt).partitionBy("_side").save(path)
