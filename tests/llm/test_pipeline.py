"""The pipeline's stages, one by one, against brute force on the small table."""

import corpus_pipeline
from quarry.llm import op1_quality

from . import brute
from .conftest import SF, pairs_of, words


def test_stages_and_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "decontaminate", "mix_sources", "token_blocks"]


def test_each_stage_takes_effect(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    seen = pairs_of(docs)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, frame, SF)
        rows = out.collect()
        if name == "token_blocks":
            assert sorted(r["doc_id"] for r in rows) == sorted(k for k, _ in seen)
            break
        assert out.columns == columns
        got = sorted((r["doc_id"], r["text"]) for r in rows)
        if name == "quality_rules":
            kept = {r["doc_id"] for r in op1_quality.measure(frame).filter("kept").collect()}
            assert got == sorted(p for p in seen if p[0] in kept)
        elif name == "ngram_jaccard_join":
            root = {k: c for k, _, c in brute.jaccard_components(seen, 5, 80)}
            assert got == sorted(p for p in seen if root[p[0]] == p[0])
        elif name == "decontaminate":
            items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = {k for k, t in seen if any(f" {i} " in f" {' '.join(words(t))} " for i in items)}
            assert not held & {k for k, _ in got} and set(got) <= set(seen) and len(got) > 0.8 * len(seen)
        elif name == "mix_sources":
            assert set(got) <= set(seen)
            assert max(got.count(p) for p in set(got)) <= 3
        frame, seen = spark.createDataFrame(rows, out.schema), got
