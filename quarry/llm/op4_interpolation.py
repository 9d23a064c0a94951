"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of two orders and a uniform floor,

    P(w | h) = a2 c(h w) / c(h)  +  a1 c(w) / N  +  a0 / (V + 1),

with its own weights for every frequency bucket of the context (powers of two of c(h)).  The
weights come from expectation-maximisation on deleted counts: the training documents of one
fold are left out of the counts and their tokens are the data the weights must explain.  After
that the counts of all training documents serve.

Counts are exact and cover the corpus: blocks of documents send their distinct words and
bigrams to key buckets, which add them up and answer with one figure per key.  No task holds
more than a block or a bucket, and a frequent word costs one entry per block.

Defined results: null or empty texts are one end token; documents with a null id train; repeated
rows count each; without training documents every count is 0 and the floor alone scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .packs import ask, bucket_bits, frames, get_counts, get_u64, join_replies, pack, put_counts, put_u64, unframe
from .staging import stage

HELD_OUT, DELETED, FOLDS = 2, 3, 7
STEPS_PER_OCTAVE = 16
U = np.uint64
_START, _END = U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A46)
TEST, TRAIN, LEFT_OUT = 0, 1, 2

SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")
FITS = "bucket int, r2 int, r1 int, n long"


def fold_part(ids: pa.Array) -> np.ndarray:
    """Part of each id: scored only, trained on, or the fold left out while weights are learned."""
    fold = np.array([-1 if k is None else zlib.crc32(str(k).encode()) % FOLDS for k in ids.to_pylist()])
    return np.where(fold == HELD_OUT, TEST, np.where(fold == DELETED, LEFT_OUT, TRAIN))


class _Tokens:
    """Token keys of a block: words and an end for each text; words even, bigrams odd."""

    def __init__(self, column: pa.Array):
        words, n_docs, sizes = [], len(column), []
        for lo, hi in tn.chunks(column):
            w = tn.tokenize(*tn.flat(column.slice(lo, hi - lo)))
            words.append(w.hash)
            sizes.append(w.counts())
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, U)
        self.n = size + 1
        self.stop = np.cumsum(self.n)
        tok = np.full(int(self.n.sum()), _END)
        tok[np.arange(len(flat)) + np.repeat(np.arange(n_docs), size)] = flat
        tok &= ~U(1)
        prev = np.empty_like(tok)
        prev[1:] = tok[:-1]
        self.first = self.stop - self.n
        prev[self.first] = _START
        self.one, self.one_at = np.unique(tok, return_inverse=True)
        self.two, self.two_at = np.unique(tn.mix(prev * U(0xD6E8FEB86659FD93) + tok) | U(1), return_inverse=True)
        self.keys = np.sort(np.concatenate([self.one, self.two]))

    def counts(self) -> np.ndarray:
        out = np.zeros(len(self.keys), np.int64)
        out[np.searchsorted(self.keys, self.one)] = np.bincount(self.one_at, minlength=len(self.one))
        out[np.searchsorted(self.keys, self.two)] = np.bincount(self.two_at, minlength=len(self.two))
        return out

    def lookup(self, figures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of the token, of its context, of both) for every token."""
        c1 = figures[np.searchsorted(self.keys, self.one)][self.one_at]
        c2 = figures[np.searchsorted(self.keys, self.two)][self.two_at]
        ctx = np.empty_like(c1)
        ctx[1:] = c1[:-1]
        if len(ctx):
            ctx[self.first] = c1[-1]  # a text starts as often as one ends
        return c1, ctx, c2


def _ask(batch: pa.RecordBatch):
    t = _Tokens(batch.column(2))
    counts = t.counts()
    return t.keys, lambda a, b: frames(put_u64(t.keys[a:b]), put_counts(counts[a:b]))


def _total(t: pa.Table) -> pa.Table:
    """Counts of a bucket's keys over all blocks; a row with block -1 has the bucket's totals."""
    parts = [unframe(p) for p in t.column("payload").to_pylist()]
    part = t.column("part").to_numpy()
    keys = [get_u64(p[0]) for p in parts]
    n = [get_counts(p[1]) for p in parts]
    size = np.array([len(k) for k in keys])
    of = np.repeat(part, size)
    uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.concatenate(n)
    core = np.bincount(inv, weights=np.where(of == TRAIN, count, 0), minlength=len(uniq)).astype(np.int64)
    full = np.bincount(inv, weights=np.where(of != TEST, count, 0), minlength=len(uniq)).astype(np.int64)
    word = (uniq & U(1)) == 0
    cut = np.cumsum(np.append(0, size))
    out = []
    for i, p in enumerate(part.tolist()):
        at = inv[cut[i]:cut[i + 1]]
        out.append(frames(put_counts(full[at]), put_counts(core[at])) if p == LEFT_OUT else frames(put_counts(full[at])))
    k = t.column("bucket")[0].as_py()
    m = t.num_rows
    return pa.table([
        pa.array([*t.column("block").to_pylist(), -1], pa.int64()), pa.array([*part.tolist(), -1], pa.int32()),
        pa.array([k] * (m + 1), pa.int32()), pa.array([*out, b""], pa.binary()),
        pa.array([0] * m + [int(full[word].sum())], pa.int64()), pa.array([0] * m + [int((full[word] > 0).sum())], pa.int64()),
        pa.array([0] * m + [int(core[word].sum())], pa.int64()), pa.array([0] * m + [int((core[word] > 0).sum())], pa.int64())],
        ["block", "part", "bucket", "reply", "n", "v", "n_core", "v_core"])


def _bucket(ctx: np.ndarray) -> np.ndarray:
    return np.where(ctx > 0, np.floor(np.log2(np.maximum(ctx, 1))).astype(np.int64) + 1, 0)


def _evidence(n_core: int, v_core: int):
    """Deleted tokens as a histogram of how both estimates compare with the floor."""
    def fn(batch: pa.RecordBatch, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        t = _Tokens(batch.column(2))
        c1, ctx, c2 = t.lookup(np.concatenate([get_counts(unframe(r)[1]) for r in replies]))
        floor = 1.0 / (v_core + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            r2 = np.where(c2 > 0, np.round(STEPS_PER_OCTAVE * np.log2(c2 / np.maximum(ctx, 1) / floor)), -(1 << 20))
            r1 = np.where(c1 > 0, np.round(STEPS_PER_OCTAVE * np.log2(c1 / max(n_core, 1) / floor)), -(1 << 20))
        rows, n = np.unique(np.stack([_bucket(ctx), r2.astype(np.int64), r1.astype(np.int64)]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[k].astype(np.int32)) for k in range(3)] + [pa.array(n)], ["bucket", "r2", "r1", "n"])

    return fn


def _maximise(pdf: pd.DataFrame) -> pd.DataFrame:
    """The weights of one bucket: EM to convergence over its histogram."""
    n = pdf["n"].to_numpy(float)
    like = np.stack([np.exp2(pdf["r2"].to_numpy(float) / STEPS_PER_OCTAVE),
                     np.exp2(pdf["r1"].to_numpy(float) / STEPS_PER_OCTAVE), np.ones(len(n))])
    a = np.full(3, 1 / 3)
    if pdf["bucket"].iloc[0] == 0:
        a = np.array([0.0, 0.5, 0.5])
    for _ in range(500):
        share = a[:, None] * like
        share /= share.sum(axis=0)
        new = (share * n).sum(axis=1) + (a > 0)  # one token of prior for each part
        new /= new.sum()
        if np.abs(new - a).max() < 1e-9:
            a = new
            break
        a = new
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "a2": [a[0]], "a1": [a[1]], "a0": [a[2]]})


def _weights(fitted: list) -> np.ndarray:
    """Weights by bucket; a bucket without evidence takes those of the nearest smaller one."""
    out = np.zeros((64, 3))
    out[0] = (0.0, 0.5, 0.5)
    known = {r["bucket"]: (r["a2"], r["a1"], r["a0"]) for r in fitted}
    for k in range(64):
        out[k] = known.get(k, out[k] if k == 0 else (out[k - 1] if k > 1 else (1 / 3, 1 / 3, 1 / 3)))
    return out


def _score(n: int, v: int, weights: np.ndarray):
    def fn(batch: pa.RecordBatch, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        t = _Tokens(batch.column(2))
        c1, ctx, c2 = t.lookup(np.concatenate([get_counts(unframe(r)[0]) for r in replies]))
        a = weights[_bucket(ctx)]
        p = a[:, 0] * c2 / np.maximum(ctx, 1) + a[:, 1] * c1 / max(n, 1) + a[:, 2] / (v + 1)
        base = np.log10((c1 + 1) / (n + v + 1))

        def total(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, t.first) if len(t.first) else np.zeros(0)

        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(fold_part(batch.column(1)) == TEST), pa.array(t.n.astype(np.int64)),
             pa.array(total((c1 > 0).astype(np.int64))), pa.array(np.full(len(t.n), n, np.int64)),
             pa.array(total(base)), pa.array(total(np.log10(p)))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return fn


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see the module text for the model and the contract for the columns."""
    packs = pack(docs, "lm-packs", id_col, text_col, fold_part)
    asked = ask(packs, bucket_bits(packs), _ask)
    schema = "block long, part int, bucket int, reply binary, n long, v long, n_core long, v_core long"
    replies = stage(asked.groupBy("bucket").applyInArrow(_total, schema), "lm-counts")
    n, v, n_core, v_core = (int(x or 0) for x in replies.filter("block = -1").agg(
        *[F.sum(c) for c in ("n", "v", "n_core", "v_core")]).first())
    left_out = join_replies(packs.filter(F.col("part") == LEFT_OUT), replies.filter(F.col("part") == LEFT_OUT),
                            _evidence(n_core, v_core), FITS)
    seen = left_out.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))
    fitted = seen.groupBy("bucket").applyInPandas(_maximise, "bucket int, a2 double, a1 double, a0 double").collect()
    return join_replies(packs, replies.filter("block >= 0"), _score(n, v, _weights(fitted)), SCORES)

