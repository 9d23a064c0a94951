"""The corpus pipeline: raw documents to token-ID blocks, one operator per stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import op1_quality, op2_mix, op3_tokens, op8_ngram_join, op10_decontam
from quarry.llm.staging import stage
from quarry.session import read_table

#: the chain ends in tokenizer ids, which SQL cannot express; tests hold it to a brute-force run
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_quality.keep(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_ngram_join.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontam.clean(docs, read_table(spark, sf_dir, "benchmark"), keep_null_ids=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_mix.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_tokens.read(op3_tokens.write(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", ngram_join), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("token_blocks", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
