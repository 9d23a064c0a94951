"""Upsert and change feed on plain DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_upsert(target: DataFrame, source: DataFrame, keys, order: str | None = None) -> DataFrame:
    """Update all / insert all by key.

    Without ``order``: target rows whose key is in the source are replaced by the source row
    (left anti join + union: one shuffle on the key).  With ``order``: per key the newest row
    of target and source wins (a late, older source row does not overwrite a newer one).
    A source key that occurs in rows with different values raises without ``order`` (a MERGE
    would refuse it too); exact repeats count once.  Upserting the same source twice gives the
    same result as once.  NULL keys are equal to each other.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = source.select(*target.columns)
    if order is not None:
        from ..operators.windows import latest_per

        return latest_per(target.unionByName(src), keys, [order])
    return _without(target, src, keys).unionByName(one_per_key(src, keys))


def one_per_key(df: DataFrame, keys) -> DataFrame:
    """The rows of ``df``, exact repeats once; a key with different rows raises when run."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1))
    text = F.to_json(row)
    g = df.groupBy(*keys).agg(F.first(row).alias("__r"), F.min(text).alias("__lo"), F.max(text).alias("__hi"))
    checked = F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("__r")).otherwise(
        F.raise_error(F.lit("a merge source holds one key with different rows")))
    g = g.withColumn("__c", checked)
    return g.select(*[F.col(c) if c in keys else F.col(f"__c.{c}").alias(c) for c in df.columns])


def _without(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other`` (NULL keys are equal)."""
    k = other.select(*[F.col(c).alias(f"__k_{c}") for c in keys]).distinct()
    return df.join(k, [df[c].eqNullSafe(k[f"__k_{c}"]) for c in keys], "left_anti")


def change_feed(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Change rows between two snapshots: insert, update_preimage, update_postimage,
    delete (``_change_type``).  Rows are compared null-safely on all non-key columns."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    vals = [c for c in old.columns if c not in keys]
    o = old.select(*[F.col(c).alias(f"o__{c}") for c in old.columns], F.lit(True).alias("__o"))
    n = new.select(*[F.col(c).alias(f"n__{c}") for c in new.columns], F.lit(True).alias("__n"))
    cond = None
    for k in keys:
        e = F.col(f"o__{k}").eqNullSafe(F.col(f"n__{k}"))
        cond = e if cond is None else cond & e
    j = o.join(n, cond, "full_outer")
    same = F.lit(True)
    for v in vals:
        same = same & F.col(f"o__{v}").eqNullSafe(F.col(f"n__{v}"))
    kind = (F.when(F.col("__o").isNull(), F.lit("insert")).when(F.col("__n").isNull(), F.lit("delete"))
            .when(~same, F.lit("update")).otherwise(F.lit(None)))
    j = j.withColumn("__kind", kind).filter(F.col("__kind").isNotNull())
    old_row = F.struct(*[F.col(f"o__{c}").alias(c) for c in old.columns])
    new_row = F.struct(*[F.col(f"n__{c}").alias(c) for c in old.columns])
    items = F.when(F.col("__kind") == "insert", F.array(F.struct(F.lit("insert").alias("t"), new_row.alias("r")))) \
        .when(F.col("__kind") == "delete", F.array(F.struct(F.lit("delete").alias("t"), old_row.alias("r")))) \
        .otherwise(F.array(F.struct(F.lit("update_preimage").alias("t"), old_row.alias("r")),
                           F.struct(F.lit("update_postimage").alias("t"), new_row.alias("r"))))
    return j.select(F.explode(items).alias("x")).select("x.r.*", F.col("x.t").alias("_change_type"))


def apply_changes(old: DataFrame, changes: DataFrame, keys) -> DataFrame:
    """Apply a change feed to a snapshot (inverse of ``change_feed``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    kept = _without(old, changes, keys)
    add = changes.filter(F.col("_change_type").isin("insert", "update_postimage")).drop("_change_type")
    return kept.unionByName(add.select(*old.columns))
