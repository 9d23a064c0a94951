"""Stored sketches per slot, merged over any range of slots instead of a rescan.

A slot's profile row holds exact counts beside an HLL sketch (distinct values) and a KLL sketch (quantiles) for each
chosen column.  Sketches merge: those of thirty slots give the distinct count and the quantiles of the whole range within
their error, from thirty small rows, however many rows the slots hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the HLL registers (relative standard error about 1.04 / sqrt(2^LG_K)), and the KLL size parameter
LG_K, KLL_K = 14, 400


def slot_sketches(df: DataFrame, slot: Column, distinct=(), quantiles=()) -> DataFrame:
    """One row per slot: rows, and per column its NULLs and its sketch."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in distinct:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_K)).alias(f"hll_{c}")]
    for c in quantiles:
        aggs.append(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"kll_{c}"))
    return df.groupBy(slot.alias("slot")).agg(*aggs)


def merge_sketches(stored: DataFrame, by=()) -> DataFrame:
    """The same columns merged over the rows of ``stored`` (per group of ``by``)."""
    aggs = []
    for c in stored.columns:
        if c == "rows" or c.startswith("nulls_"):
            aggs.append(F.sum(c).alias(c))
        elif c.startswith("hll_"):
            aggs.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("kll_"):
            aggs.append(F.kll_merge_agg_double(c, F.lit(KLL_K)).alias(c))
    return stored.groupBy(*by).agg(*aggs)


def read_sketches(merged: DataFrame, at=(0.5, 0.95, 0.99)) -> DataFrame:
    """Estimates: ``distinct_<column>`` and ``quantiles_<column>`` (an array, in the order of ``at``)."""
    keep = [c for c in merged.columns if not c.startswith(("hll_", "kll_"))]
    out = [F.col(c) for c in keep]
    for c in merged.columns:
        if c.startswith("hll_"):
            out.append(F.hll_sketch_estimate(c).alias(f"distinct_{c[4:]}"))
        elif c.startswith("kll_"):
            out.append(F.array(*[F.kll_sketch_get_quantile_double(c, F.lit(float(q))) for q in at]).alias(f"quantiles_{c[4:]}"))
    return merged.select(*out)
