"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Seeds are the word 3-grams of the test items (A-Z lower-cased).  One pass over the corpus
   counts each seed's occurrences.
2. An item keeps as seeds its rarer half: the n-grams whose corpus count is not above the
   item's median.  The rule is relative to the item, so a widely leaked item keeps seeds too.
3. A second pass joins the passages to the items on the kept seeds.  Hits of a document and an
   item on neighbouring diagonals form one window; a local alignment over words (match 2,
   mismatch -1, gap -1) scores it against the item's perfect score.  Edited, cut or
   re-ordered copies lose only what was changed.

Test items are handled in blocks of at most ``BLOCK_WORDS`` words: a block is the largest thing
sent to the executors, whatever the benchmark's size, and each block sees all documents.

Defined results: null or empty texts and items match nothing; items shorter than three words
are seeded with their whole word sequence; equal items, and items that share an id, each report; repeated
rows each report; null ids of documents and items are reported as null.  A document is read by one task, so its
windows are gathered to one row per item there, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .staging import empty, indexed, numbered, stage

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
BLOCK_WORDS = 1_000_000
HITS = "doc_id long, item_id long, score double, first_word long, end_word long, n_passages long"


def _windows(w: tn.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams, and whole sequences of texts with fewer words."""
    keys, at = tn.ngrams(w, n)
    for k in range(1, n):
        short = np.flatnonzero(w.counts() == k)
        if len(short):
            kk, aa = tn.ngrams(w, k)
            sel = np.isin(aa, w.first[short])
            keys, at = np.concatenate([keys, kk[sel]]), np.concatenate([at, aa[sel]])
    return keys, at


def _item_grams(rows: list) -> tuple[np.ndarray, np.ndarray, tn.Words]:
    col = pa.array([r["text"] for r in rows], pa.string())
    w = tn.tokenize(*tn.flat(col))
    keys, at = _windows(w, N)
    return keys, w.doc()[at], w


def _doc_keys(w: tn.Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    ks, ats = zip(*(tn.ngrams(w, n) for n in lengths))
    return np.concatenate(ks), np.concatenate(ats)


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in ``sorted_keys`` of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def _counts(docs: DataFrame, seeds, lengths: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seeds.value
        tot = np.zeros(len(known), np.int64)
        for b in batches:
            for lo, hi in tn.chunks(b.column(1)):
                w = tn.tokenize(*tn.flat(b.column(1).slice(lo, hi - lo)))
                at = _lookup(known, _doc_keys(w, lengths)[0])
                tot += np.bincount(at[at >= 0], minlength=len(known))
        got = np.flatnonzero(tot)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(tot[got])], ["seed", "n"])

    return docs.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def align(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of ``a`` (lengths ``la``) with that of ``b``.

    All pairs advance together, one row of the table per step; gaps along the row come from a
    running maximum.
    """
    n, wa = a.shape
    wb = b.shape[1]
    best = np.zeros(n, np.int64)
    row = np.zeros((n, wb + 1), np.int64)
    ramp = -GAP * np.arange(wb + 1)
    inside = np.arange(wb)[None, :] < lb[:, None]
    for i in range(wa):
        hit = (a[:, i:i + 1] == b) & inside
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(hit, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        new[:, 1:][~inside] = 0
        live = i < la
        row = np.where(live[:, None], new, row)
        best = np.maximum(best, np.where(live, new.max(axis=1), 0))
    return best


def _pad(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    width = int(length.max()) if len(length) else 0
    at = start[:, None] + np.arange(width)[None, :]
    return np.where(np.arange(width)[None, :] < length[:, None], flat[np.minimum(at, len(flat) - 1)], 0)


def _score(w: tn.Words, hit_doc, hit_at, hit_item, hit_pos, item: tn.Words, min_score: float):
    """(doc index, item index, score, first word, last word) of the passages that reach the score."""
    n_item = item.counts()
    diag = hit_at - w.first[hit_doc] - hit_pos
    order = np.lexsort((diag, hit_item, hit_doc))
    d, it, dg, at = hit_doc[order], hit_item[order], diag[order], hit_at[order]
    slack = np.maximum(8, n_item[it] // 2)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (dg[1:] - dg[:-1] > slack[1:])
    head = np.flatnonzero(new)
    d, it, lo, hi = d[head], it[head], dg[head], dg[np.append(head[1:], len(dg)) - 1]
    margin = np.maximum(8, n_item[it] // 2)
    start = w.first[d] + np.maximum(lo - margin, 0)
    stop = np.minimum(w.first[d] + hi + n_item[it] + margin, w.first[d + 1])
    score = np.zeros(len(d))
    # rows of similar size together, so padding stays small
    order = np.lexsort((stop - start, n_item[it]))
    i = 0
    while i < len(order):
        j, wide = i, 1
        while j < len(order) and (j == i or (j - i + 1) * wide < 400_000):
            wide = max(wide, int(stop[order[j]] - start[order[j]]))
            j += 1
        sel = order[i:j]
        a = _pad(item.hash, item.first[it[sel]], n_item[it[sel]])
        b = _pad(w.hash, start[sel], (stop - start)[sel])
        score[sel] = align(a, n_item[it[sel]], b, (stop - start)[sel]) / (MATCH * n_item[it[sel]])
        i = j
    ok = score >= min_score
    return d[ok], it[ok], score[ok], start[ok], stop[ok]


def _matches(docs: DataFrame, block, lengths: list[int], min_score: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = block.value
        item = tn.Words(None, None, v["hash"], v["first"])
        for b in batches:
            for lo, hi in tn.chunks(b.column(1)):
                w = tn.tokenize(*tn.flat(b.column(1).slice(lo, hi - lo)))
                keys, at = _doc_keys(w, lengths)
                got = _lookup(v["seed"], keys)
                at, got = at[got >= 0], got[got >= 0]
                if not len(at):
                    continue
                n = v["cut"][got + 1] - v["cut"][got]
                ref = np.repeat(v["cut"][got], n) + tn.ragged(n)
                at = np.repeat(at, n)
                d, it, s, x, y = _score(w, w.doc()[at], at, v["item"][ref], v["pos"][ref], item, min_score)
                if len(d):
                    # the best passage of each document and item, the first of equals, and their number
                    order = np.lexsort((x, -s, it, d))
                    d, it, s, x, y = (c[order] for c in (d, it, s, x, y))
                    head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (it[1:] != it[:-1])))
                    n = np.diff(np.append(head, len(d)))
                    d, it, s, x, y = (c[head] for c in (d, it, s, x, y))
                    ids = b.column(0).slice(lo, hi - lo).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays(
                        [ids, v["ids"].take(pa.array(it)), pa.array(s), pa.array(x - w.first[d]), pa.array(y - w.first[d]), pa.array(n)],
                        [f.split()[0] for f in HITS.split(", ")])

    return docs.mapInArrow(run, HITS)


def find(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document row and test item that align: best score, the word span it covers, and how many passages."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")) \
        .filter(F.col("text").isNotNull())
    items = indexed(items.withColumn("_n", F.length("text") + 1), [F.col("item_id"), F.col("text")], "bench", "_n")
    items = stage(items.withColumn("_block", F.floor(F.col("before") / (BLOCK_WORDS * 4)).cast("int")), "bench-blocks")
    blocks = [r[0] for r in items.select("_block").distinct().orderBy("_block").toLocalIterator()]
    out = empty(spark, HITS)
    for k in blocks:
        held = items.filter(F.col("_block") == k).select("item_id", "text").collect()
        keys, of, w = _item_grams(held)
        if not len(keys):
            continue
        at = _windows(w, N)[1]
        lengths = sorted({N} | {int(c) for c in np.unique(w.counts()) if 0 < c < N})
        seed = np.unique(keys)
        sent = spark.sparkContext.broadcast(seed)
        tot = np.zeros(len(seed), np.int64)
        for r in _counts(rows, sent, lengths).toLocalIterator():
            tot[r[0]] = r[1]
        df = tot[np.searchsorted(seed, keys)]
        kept = df <= _medians(of, df, len(held))[of]
        keys, of, at = keys[kept], of[kept], at[kept]
        order = np.argsort(keys, kind="stable")
        keys, of, at = keys[order], of[order], at[order]
        seed, first = np.unique(keys, return_index=True)
        value = {"seed": seed, "cut": np.append(first, len(keys)), "item": of, "pos": at - w.first[of],
                 "ids": pa.array([r["item_id"] for r in held], pa.int64()),
                 "hash": w.hash, "first": w.first}
        out = out.unionByName(_matches(rows, spark.sparkContext.broadcast(value), lengths, min_score))
    return out


def _medians(of: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((df, of))
    o, v = of[order], df[order]
    first = np.searchsorted(o, np.arange(n))
    count = np.searchsorted(o, np.arange(n), side="right") - first
    mid = np.zeros(n)
    has = count > 0
    mid[has] = v[first[has] + (count[has] - 1) // 2]
    return mid


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", keep_null_ids: bool = True, **kw) -> DataFrame:
    """``docs`` without the rows that hold a test item (all columns).  Decided by row: of rows that share an id
    only those that hold an item go.  Rows without an id stay, or are decided like any others."""
    rows, row = numbered(docs, "bench-rows")
    bad = find(rows, bench, id_col=row, **kw).select(F.col("doc_id").alias(row)).distinct()
    if keep_null_ids:
        bad = bad.join(rows.filter(F.col(id_col).isNotNull()).select(row), row, "left_semi")
    return rows.join(bad, row, "left_anti").select(*docs.columns)
