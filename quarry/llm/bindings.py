"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.bindings import Registry

from . import (op1_quality, op2_mix, op3_tokens, op4_interpolation, op5_secrets, op6_repeats, op7_lines, op8_ngram_join,
               op9_licenses, op10_decontam, op11_stream_dedup, op12_prefix_trie, op13_simplex_clusters, sql)

REG = Registry()


@REG.query("op1_quality_rules", oracle=sql.quality())
def _op1(t):
    """Repetition coverage and base counts of every document."""
    return op1_quality.measure(t.documents)


@REG.query("op2_mix_sources")
def _op2(t):
    """Capped water-filling of all sources; words taken per document."""
    return op2_mix.mix(t.documents)


@REG.query("op3_token_blocks")
def _op3(t):
    """Token ids written as block records and read back: place, count, checksum."""
    return op3_tokens.read(op3_tokens.write(t.documents, public_tokenizers.path("byte_bpe_50k.json")))


@REG.query("op4_lm_scores")
def _op4(t):
    """Deleted-interpolation and base scores of every document."""
    return op4_interpolation.score(t.documents)


@REG.query("op5_secret_scan", oracle=sql.secrets())
def _op5(t):
    """Secret spans with corpus-wide ownership of the values."""
    return op5_secrets.scan(t.documents)


@REG.query("op6_repeat_dedup")
def _op6(t):
    """Bytes left after removing 50-byte repeats of earlier documents."""
    return op6_repeats.dedup(t.documents)


@REG.query("op7_line_dedup")
def _op7(t):
    """Lines like an earlier line, by exact set-similarity join."""
    return op7_lines.dedup(t.documents)


@REG.query("op8_ngram_jaccard", oracle=sql.ngram_join())
def _op8(t):
    """Components of 4-word Jaccard links at 0.85."""
    return op8_ngram_join.link(t.documents)


@REG.query("op9_license_scan")
def _op9(t):
    """Own and inherited licences."""
    # documents have no path: source and language are directories, in shelves of 1,000 ids
    shelf = F.floor(F.col("doc_id") / 1000).cast("string")
    return op9_licenses.scan(t.documents, F.concat_ws("/", "source", "lang", shelf, F.col("doc_id").cast("string")), short_files=True)


@REG.query("op10_decontaminate")
def _op10(t):
    """Documents that hold a test item, aligned."""
    return op10_decontam.find(t.documents, t.benchmark)


@REG.query("op11_stream_dedup", oracle=sql.stream_dedup())
def _op11(t):
    """Exact dedup by a stream with disk-backed keyed state; hits checked in full."""
    return op11_stream_dedup.dedup(t.spark, f"{t.sf_dir.rstrip('/')}/documents.parquet")


@REG.query("op12_prefix_trie", oracle=sql.prefix_trie())
def _op12(t):
    """Nodes of the conversations' prefix trie, peeled from the greatest depth."""
    return op12_prefix_trie.trie(t.conversations).drop("key", "parent")


@REG.query("op13_simplex_clusters", oracle=sql.clusters())
def _op13(t):
    """Centroid clustering with exact integer distances behind n-simplex bounds."""
    return op13_simplex_clusters.cluster(t.embeddings)
