"""Projections and filters (P1-P5, P8-P11, P13).  All are narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with NULL in any of ``cols``."""
    return df.dropna(subset=list(cols))


def cast_cols(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns in place (ANSI mode decides whether bad values fail or become NULL)."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def parse_cols(df: DataFrame, formats: dict[str, tuple[str, str]]) -> DataFrame:
    """Parse string columns with a pattern: ``{col: ('timestamp'|'date', pattern)}``."""
    out = []
    for c in df.columns:
        if c in formats:
            kind, fmt = formats[c]
            fn = F.to_date if kind == "date" else F.to_timestamp
            out.append(fn(F.col(c), fmt).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def derive_date(df: DataFrame, ts: str, out: str) -> DataFrame:
    """A date column from a timestamp."""
    return df.withColumn(out, F.to_date(ts))


def stamp_processed(df: DataFrame, out: str = "_processed_at") -> DataFrame:
    """Processing-time column (one value per query, as ``current_timestamp`` is folded)."""
    return df.withColumn(out, F.current_timestamp())


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5: drop columns."""
    return df.drop(*cols)


def search_tables(tables: DataFrame, text: str, limit: int = 20, fields=("name", "schema")) -> DataFrame:
    """Case-insensitive substring search over names; first ``limit`` by name."""
    q = text.lower()
    cond = None
    for f in fields:
        e = F.lower(F.col(f)).contains(q)
        cond = e if cond is None else cond | e
    return tables.filter(cond).orderBy(*fields).limit(limit)


def recent(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows with ``ts >= as_of - days`` (as_of is a parameter, never the clock)."""
    a = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return df.filter(F.col(ts) >= a - F.expr(f"INTERVAL {int(days)} DAYS"))


def match_regex(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """P10: rows whose column matches a Java regex."""
    return df.filter(F.col(col).rlike(pattern))


def model(df: DataFrame, mapping: dict[str, Column | str], where: Column | str | None = None) -> DataFrame:
    """Filter, then project to the modelled columns (``{out_name: expr}``)."""
    if where is not None:
        df = df.filter(where)
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()])


def dev_sample(df: DataFrame, ts: str, days: int, fraction: float, key: str, as_of, salt: str = "") -> DataFrame:
    """Recent window (last ``days`` days), and the rows whose hashed key falls in the first
    ``fraction`` of the hash range: the same keys on every run, whatever the partitioning."""
    bound = f"{round(fraction * (1 << 32)):08x}"
    digest = F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 8)
    return recent(df, ts, days, as_of).filter(digest < bound if fraction < 1 else F.lit(True))
