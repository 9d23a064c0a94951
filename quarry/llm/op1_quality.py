"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes (numpy, one pass per Arrow batch) find the word
windows that occur twice or more in a text; the measure is the share of the text's word
characters inside such windows, and likewise the share inside repeated lines.  A window can
only repeat if its first n-1 words repeat, so each length looks at the survivors of the one
before.

Defined results: a null or empty text has zero counts and fails the base rule (fewer than 50
words); a null id is carried through; repeated rows are each judged alone; whole texts of any
length are read.  Extra columns are ignored by ``measure`` and kept as they are by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn

#: fixed values: published limits of the share of word characters inside repeated windows of n words, and
#: inside repeated lines
PUBLISHED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
PUBLISHED_LINES = 0.20
#: the limits used: those of ``fit_limits`` on the 0.1 tables, rounded up to hundredths
MAX_SHARE = {5: 0.22, 6: 0.22, 7: 0.22, 8: 0.22, 9: 0.22, 10: 0.10}
MAX_LINE_SHARE = 0.20
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

SHARES = [f"dup_share_{n}" for n in MAX_SHARE]
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, dup_line_share double, "
          + ", ".join(f"{s} double" for s in SHARES) + ", base_failed boolean, kept boolean")


def _covered(n_items: int, at: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside windows of ``n`` words that start at ``at``."""
    edge = np.zeros(n_items + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _within(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return tn.repeated(tn.mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    buf, offs = tn.flat(column)
    n_docs = len(column)
    w = tn.tokenize(buf, offs, lower=False)
    doc = w.doc()
    in_word = tn.IS_WORD[buf]
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(in_word & ((buf & 0xC0) != 0x80), out=points[1:])
    chars = points[w.end] - points[w.start]
    out = {"n_words": w.counts().astype(np.int64), "word_chars": tn.sums(chars, w.first),
           "n_symbols": tn.sums(_IS_SYMBOL[buf], offs)}

    # lines: split on \n, a line counts if it has a word
    stop = np.flatnonzero(buf == 10)
    starts = np.union1d(stop + 1, offs[:-1])
    starts = starts[starts < len(buf)]
    line_doc = np.searchsorted(offs, starts, side="right") - 1
    ends = np.minimum(np.append(stop, len(buf))[np.searchsorted(stop, starts)], offs[line_doc + 1])
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[has_word], ends[has_word], line_doc[has_word]
    key = tn.span_hash(buf, starts, ends, tn.BYTE_CODE) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((np.arange(len(key)), key, line_doc))
    k, d = key[order], line_doc[order]
    later = np.zeros(len(key), bool)
    if len(k) > 1:
        later[order[1:][(k[1:] == k[:-1]) & (d[1:] == d[:-1])]] = True
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs).astype(np.int64)
    line_chars = points[ends] - points[starts]
    dup_line = np.bincount(line_doc[later], weights=line_chars[later], minlength=n_docs)

    # windows: 3 words for the base count, then the lengths of the rule
    keys, at = tn.ngrams(w, 3)
    hit = at[_within(keys, doc[at])] if len(at) else at
    cov = _covered(len(doc), hit, 3)
    out["n_repeat_words"] = tn.sums(cov, w.first)
    total = np.maximum(out["word_chars"], 1)
    out["dup_line_share"] = dup_line / total
    for n, name in zip(MAX_SHARE, SHARES):
        keys, at = tn.ngrams(w, n)
        alive = np.zeros(len(doc) + 1, bool)
        alive[hit] = True
        sel = alive[at] if len(at) else np.zeros(0, bool)
        keys, at = keys[sel], at[sel]
        hit = at[_within(keys, doc[at])] if len(at) else at
        cov = _covered(len(doc), hit, n)
        out[name] = tn.sums(np.where(cov, chars, 0), w.first) / total
    out["base_failed"] = ((out["n_words"] < MIN_WORDS)
                          | (100 * out["n_repeat_words"] > 50 * out["n_words"]))
    bad = out["dup_line_share"] > MAX_LINE_SHARE
    for n, name in zip(MAX_SHARE, SHARES):
        bad |= out[name] > MAX_SHARE[n]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, coverage shares and the verdict ``kept``."""
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tn.chunks(b.column(1)):
                m = measures(b.column(1).slice(lo, hi - lo))
                cols = [b.column(0).slice(lo, hi - lo).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(m[n]) for n in names], ["doc_id", *names])

    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tn.chunks(b.column(at)):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(measures(part.column(at))["kept"]))

    return docs.mapInArrow(run, docs.schema)


def fit_limits(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, most: int = 20_000, id_col: str = "doc_id",
               text_col: str = "text") -> dict[str, float]:
    """Limits that leave labelled good documents alone: per measure the ``quantile`` of those that pass the base rule,
    or the published limit where that is larger.  Fitted on ``most`` labelled rows at most, those with the smallest hash."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_good")).distinct() \
        .orderBy(F.xxhash64("_good"), "_good").limit(most)
    sample = docs.join(good, docs[id_col] == good["_good"], "left_semi")
    names = ["dup_line_share", *SHARES]
    row = measure(sample, id_col, text_col).filter("NOT base_failed").agg(*[F.percentile(c, quantile).alias(c) for c in names]).first()
    return {c: max(low, row[c] or 0.0) for c, low in zip(names, [PUBLISHED_LINES, *PUBLISHED.values()])}
