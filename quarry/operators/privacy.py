"""PII masking and development samples (P12; P13 lives in transforms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plain-class patterns for personal data in free text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z][A-Za-z]+"
PHONE = r"\+?[0-9][0-9 ()-]{7,}[0-9]"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def mask_value(col: Column, policy: str, salt: str = "") -> Column:
    """One column under a policy: ``hash`` (salted SHA-256), ``mask`` (letters / digits
    replaced), ``email`` (local part hidden), ``null``, ``scrub`` (PII in free text replaced)."""
    if policy == "hash":
        return F.sha2(F.concat(F.lit(salt), col.cast("string")), 256)
    if policy == "mask":
        return F.mask(col.cast("string"))
    if policy == "email":
        return F.regexp_replace(col, r"^[^@]+@", "***@")
    if policy == "null":
        return F.lit(None).cast("string")
    if policy == "scrub":
        c = F.regexp_replace(col, EMAIL, "<EMAIL>")
        c = F.regexp_replace(c, IPV4, "<IP>")
        return F.regexp_replace(c, PHONE, "<PHONE>")
    raise ValueError(f"unknown masking policy {policy!r}")


def mask_pii(df: DataFrame, policies: dict[str, str], salt: str = "") -> DataFrame:
    """Apply a policy per column, other columns unchanged (narrow, no shuffle)."""
    return df.select(*[mask_value(F.col(c), policies[c], salt).alias(c) if c in policies else F.col(c)
                       for c in df.columns])
