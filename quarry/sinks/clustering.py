"""Z-order clustering, so that every clustering column prunes files, not the first alone.

``cluster_by`` sorts by its columns one after the other: only the first one's range is narrow in a file.
``z_order`` ranks each column (``2^bits`` ranges of about equal rows, by one approximate quantile pass over all columns),
interleaves the bits of the ranks to one number and range-partitions by it: rows near in all columns share a file.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 8


def ordinal(df: DataFrame, name: str) -> Column:
    """A number in the order of the column; strings by their first six bytes."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def z_key(df: DataFrame, cols, bits: int = BITS) -> DataFrame:
    """``df`` with ``__z``: the interleaved ranks of ``cols``; NULL ranks last."""
    cols = list(cols)
    if not cols or bits * len(cols) > 62:
        raise ValueError("one column at least, and at most 62 bits in all")
    ordered = df.withColumns({f"__o{i}": ordinal(df, c) for i, c in enumerate(cols)})
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = ordered.agg(*[F.percentile_approx(f"__o{i}", shares, 10_000).alias(f"q{i}") for i in range(len(cols))]).first()
    # quantiles of one column are at most 2^bits numbers
    splits = [[float("-inf"), *sorted(set(row[f"q{i}"] or [])), float("inf")] for i in range(len(cols))]
    splits = [s if len(s) > 2 else [s[0], 0.0, s[1]] for s in splits]
    ranked = Bucketizer(splitsArray=splits, inputCols=[f"__o{i}" for i in range(len(cols))],
                        outputCols=[f"__r{i}" for i in range(len(cols))], handleInvalid="keep").transform(ordered)
    rank = [F.least(F.col(f"__r{i}").cast("long"), F.lit((1 << bits) - 1)) for i in range(len(cols))]
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for i, r in enumerate(rank):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(r, bit).bitwiseAND(1), bit * len(cols) + len(cols) - 1 - i))
    return ranked.withColumn("__z", key).drop(*[f"__{x}{i}" for x in "or" for i in range(len(cols))])


def z_order(df: DataFrame, cols, n: int | None = None, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` in ``n`` partitions (or by the session's setting) along the Z curve of ``cols``."""
    z = z_key(df, cols, bits)
    # equal keys may be many: the columns themselves split them further
    by = ["__z", *cols]
    r = z.repartitionByRange(n, *by) if n else z.repartitionByRange(*by)
    return r.sortWithinPartitions(*by).drop("__z")


def zone_map(df: DataFrame, cols) -> DataFrame:
    """Per file of a table just read: rows, and least and greatest value of each column."""
    ends = [f(F.col(f"`{c}`")).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends)


def files_touched(col: str, low, high) -> Column:
    """Aggregate over a ``zone_map``: the files that a range filter on ``col`` can't skip."""
    return F.count_if((F.col(f"max_{col}") >= F.lit(low)) & (F.col(f"min_{col}") <= F.lit(high)))
