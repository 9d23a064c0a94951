"""Bindings for PII masking (P12) on documents and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.privacy import mask_pii
from . import Registry

REG = Registry()


@REG.query("p12_mask_pii", oracle="""
WITH e AS (SELECT *, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z][A-Za-z]+', '<EMAIL>', 'g') AS a FROM documents),
i AS (SELECT *, regexp_replace(a, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '<IP>', 'g') AS b FROM e)
SELECT doc_id, sha256('salt-1' || CAST(doc_id AS VARCHAR)) AS doc_token,
       md5(regexp_replace(b, '\\+?[0-9][0-9 ()-]{7,}[0-9]', '<PHONE>', 'g')) AS text FROM i
""")
def _p12(t):
    """Salted hash of the id, and personal data replaced in the whole text (``scrub``)."""
    d = t.documents.select("doc_id", F.col("doc_id").alias("doc_token"), "text")
    return mask_pii(d, {"doc_token": "hash", "text": "scrub"}, "salt-1").withColumn("text", F.md5("text"))


@REG.query("p12_mask_columns", oracle="""
SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name,
       NULL AS c_acctbal FROM customer
""")
def _p12b(t):
    """Column policies: mask letters and digits, null out a column."""
    c = t.customer.select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    return mask_pii(c, {"c_name": "mask", "c_acctbal": "null"})
