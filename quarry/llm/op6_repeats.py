"""Suffix-array dedup by maximal repeats across documents.

Goal: every byte of a text that lies in a ``LENGTH``-byte string which also starts in a document
with a smaller id is removed.

1. Anchors.  In every 50-byte window the 24-byte string with the smallest hash is an anchor
   (all of them, if equal).  The choice depends on the window's bytes alone, so two documents
   that share a 50-byte string share an anchor at the same place in it.  A bulk exchange keeps
   the anchors that occur in two documents or more.
2. Contexts.  An anchor's context is its text with 26 bytes on either side, inside its document:
   it holds every 50-byte string around the anchor.  Equal contexts of an anchor form a class
   with its smallest document.  Later documents of a class lose the context whole.  Only the
   first document of each class, where an anchor has several, still needs comparing.
3. Suffix arrays.  The contexts of those firsts are dealt by anchor.  A task sorts their suffixes
   (rank doubling), takes the LCP array, and scans it with a stack for the intervals of the
   common-prefix tree that are ``LENGTH`` deep.  Intervals whose occurrences differ in the byte to
   their left are maximal repeats; each yields all its occurrences, and those in documents after
   the group's smallest are removed.
4. The marks of both kinds meet per document.

An anchor with more than ``wide`` classes (a passage in a large share of all documents, each time
between other texts) is not sent to one task: its 50-byte strings are aggregated by hash over the
cluster instead, with the same result.

Defined results: texts are read as UTF-8 bytes; null or empty texts and texts under 50 bytes
lose nothing; rows that repeat an id count as one document (the order within an id has no
smaller id); a null id sorts before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .packs import (answer, ask, bucket_bits, frames, get_u32, get_u64, join_replies, pack, put_u32,
                    put_u64, seal, squeeze, unframe, unseal, unsqueeze)
from .staging import stage

LENGTH = 50
ANCHOR = 24
SIDE = LENGTH - ANCHOR
SPAN = SIDE + 1
WIDE = 20_000
NULL_ID = -(1 << 63)
U = np.uint64


# ---------------------------------------------------------------- anchors and contexts

def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, aligned at the first."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[:len(x) - width + 1], out[width - have:])
    return out


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a batch of texts."""
    n = len(buf)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = tn.rolling(buf, ANCHOR)
    low = _slide(h, SPAN, np.minimum)  # one per window start
    room = np.zeros(n + 1, np.int32)
    ends = offs[1:]
    size = np.diff(offs)
    ok = size >= LENGTH
    np.add.at(room, offs[:-1][ok], 1)
    np.add.at(room, ends[ok] - LENGTH + 1, -1)
    valid = np.cumsum(room)[:len(low)] > 0
    low = np.where(valid, low, U(0))
    wide = np.concatenate([np.zeros(SIDE, U), low, np.zeros(SIDE, U)])
    best = _slide(wide, SPAN, np.maximum)[:len(h)]
    place = np.flatnonzero((best == h) & (best > 0))
    return place, h[place]


def _block_anchors(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, buffer, offsets, places, hashes) of slices of a block's texts."""
    for lo, hi in tn.chunks(col):
        buf, offs = tn.flat(col.slice(lo, hi - lo))
        place, h = anchors(buf, offs)
        yield lo, buf, offs, place, h


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> U(32 - bits) << U(32 - bits)


def _ask_shared(bits: int):
    def keys_of(batch: pa.RecordBatch):
        keys, docs = [], []
        ids = batch.column(1).fill_null(NULL_ID).to_numpy()
        for lo, _, offs, place, h in _block_anchors(batch.column(2)):
            keys.append(_short(h, bits))
            docs.append(ids[lo + np.searchsorted(offs, place, side="right") - 1])
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(keys, kind="stable")
        k, d = keys[order], docs[order]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        many = (np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)) if len(head) else np.zeros(0, bool)
        k = k[head]
        low = (k << U(bits) >> U(32)).astype(np.uint32)
        return k, lambda a, b: frames(put_u32(low[a:b]), squeeze(np.packbits(many[a:b])))

    return keys_of


def _shared(payloads: list[bytes], _blocks: list[int]) -> list[bytes]:
    """Per key: does it occur in several documents (or in several blocks)?"""
    keys, many = [], []
    for p in payloads:
        k, m = unframe(p)
        keys.append(get_u32(k))
        many.append(np.unpackbits(np.frombuffer(unsqueeze(m), np.uint8))[:len(keys[-1])].astype(bool))
    size = np.array([len(k) for k in keys])
    uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
    hit = (np.bincount(inv, minlength=len(uniq)) > 1) | (np.bincount(inv, weights=np.concatenate(many), minlength=len(uniq)) > 0)
    got, cut = hit[inv], np.cumsum(np.append(0, size))
    return [squeeze(np.packbits(got[cut[i]:cut[i + 1]])) + int(size[i]).to_bytes(4, "little") for i in range(len(size))]


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _open(bits: int):
    """Keeps the documents that have a shared anchor, with those anchors' places."""
    def fn(batch: pa.RecordBatch, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        flags = [np.unpackbits(np.frombuffer(unsqueeze(r[:-4]), np.uint8))[:int.from_bytes(r[-4:], "little")] for r in replies]
        flags = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        got = list(_block_anchors(batch.column(2)))
        known = tn.distinct(np.concatenate([_short(h, bits) for *_, h in got])) if got else np.zeros(0, U)
        places: list = [None] * len(batch)
        for lo, _, offs, place, h in got:
            sel = flags[np.searchsorted(known, _short(h, bits))] if len(h) else np.zeros(0, bool)
            doc = np.searchsorted(offs, place[sel], side="right") - 1
            inside = place[sel] - offs[doc]
            cut = np.searchsorted(doc, np.arange(len(offs)))
            for i in np.unique(doc).tolist():
                places[lo + i] = put_u32(inside[cut[i]:cut[i + 1]].astype(np.uint32))
        live = np.array([p is not None for p in places], bool)
        texts = batch.column(2).filter(pa.array(~live)).to_pylist()
        raw = [(t or "").encode() for t in texts]
        closed = pa.RecordBatch.from_arrays(
            [batch.column(1).filter(pa.array(~live)), pa.array([len(t) for t in raw], pa.int64()),
             pa.array([_digest(t) for t in raw], pa.string())], ["doc_id", "n_bytes", "kept_sha256"])
        alive = pa.RecordBatch.from_arrays(
            [c.filter(pa.array(live)) for c in batch.columns] + [pa.array([p for p in places if p is not None], pa.binary())],
            ["rid", "doc_id", "text", "places"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([batch.column(0)[0].as_py()], pa.int64()), pa.array([0], pa.int32()),
             pa.array([seal(alive) if live.any() else None], pa.binary()), pa.array([seal(closed)], pa.binary())],
            ["block", "part", "payload", "closed"])

    return fn


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            c = unseal(raw)
            zero = pa.array(np.zeros(len(c), np.int64))
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), zero, zero, c.column(2)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


class _Contexts:
    """Contexts of a block's shared anchors, and their classes sorted by (anchor, context)."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column(1).fill_null(NULL_ID).to_numpy()
        row, lo, hi, anchor, ctx = [], [], [], [], []
        all_places = batch.column(3).to_pylist()
        for a, b in tn.chunks(batch.column(2)):
            buf, offs = tn.flat(batch.column(2).slice(a, b - a))
            per = [get_u32(p).astype(np.int64) for p in all_places[a:b]]
            n = np.array([len(p) for p in per])
            doc = np.repeat(np.arange(b - a), n)
            at = np.concatenate(per) + offs[doc]
            start, end = np.maximum(at - SIDE, offs[doc]), np.minimum(at + LENGTH, offs[doc + 1])
            anchor.append(tn.span_hash(buf, at, at + ANCHOR, tn.BYTE_CODE))
            body = tn.span_hash(buf, start, end, tn.BYTE_CODE)
            ctx.append(tn.mix(body + (at - start).astype(U)))
            row.append(doc + a)
            lo.append(start - offs[doc])
            hi.append(end - offs[doc])
        self.row, self.lo, self.hi = np.concatenate(row), np.concatenate(lo), np.concatenate(hi)
        self.anchor, self.ctx = np.concatenate(anchor), np.concatenate(ctx)
        doc = self.ids[self.row]
        order = np.lexsort((doc, self.ctx, self.anchor))
        a, c = self.anchor[order], self.ctx[order]
        new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
        self.head = order[new]  # each class's first document in this block
        self.cls = np.empty(len(order), np.int64)
        self.cls[order] = np.cumsum(new) - 1


def _ask_classes(batch: pa.RecordBatch):
    c = _Contexts(batch)
    a, x, d = c.anchor[c.head], c.ctx[c.head], c.ids[c.row[c.head]]
    return a, lambda i, j: frames(put_u64(a[i:j]), squeeze(x[i:j]), squeeze(d[i:j]))


LATER, APART, FAR = 1, 2, 4


def _classes(wide: int):
    def reply(payloads: list[bytes], _blocks: list[int]) -> list[bytes]:
        """Flags per class: has an earlier document elsewhere; its anchor has several classes; very many."""
        a, x, d = [], [], []
        for p in payloads:
            f = unframe(p)
            a.append(get_u64(f[0]))
            x.append(np.frombuffer(unsqueeze(f[1]), U))
            d.append(np.frombuffer(unsqueeze(f[2]), np.int64))
        size = np.array([len(k) for k in a])
        a, x, d = np.concatenate(a), np.concatenate(x), np.concatenate(d)
        order = np.lexsort((d, x, a))
        sa, sx, sd = a[order], x[order], d[order]
        new = np.append(True, (sa[1:] != sa[:-1]) | (sx[1:] != sx[:-1]))
        cls = np.cumsum(new) - 1
        flag = (sd > sd[new][cls]).astype(np.uint8) * LATER
        firsts = sa[new]
        uniq, inv, count = np.unique(firsts, return_inverse=True, return_counts=True)
        n = count[inv][cls]
        flag |= np.where(n > wide, FAR, np.where(n > 1, APART, 0)).astype(np.uint8)
        out = np.empty(len(a), np.uint8)
        out[order] = flag
        cut = np.cumsum(np.append(0, size))
        return [squeeze(out[cut[i]:cut[i + 1]]) for i in range(len(size))]

    return reply


MARKED = "rid long, doc_id long, marks binary, body binary, firsts binary"


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of byte ranges."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    head = np.flatnonzero(new)
    return lo[head], hi[np.append(head[1:], len(lo)) - 1]


def _apply(batch: pa.RecordBatch, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Marks of the later documents, and the contexts of the firsts that need comparing."""
    c = _Contexts(batch)
    flag = np.concatenate([np.frombuffer(unsqueeze(r), np.uint8) for r in replies])[c.cls]
    doc = c.ids[c.row]
    first = c.ids[c.row[c.head]][c.cls]
    gone = ((flag & LATER) > 0) | (doc > first)
    gone &= c.hi - c.lo >= LENGTH
    pend = ~gone & ((flag & (APART | FAR)) > 0)
    texts = batch.column(2).to_pylist()
    cut = np.searchsorted(c.row, np.arange(len(batch) + 1))
    rid, ids, marks, body, firsts = [], [], [], [], []
    for i in range(len(batch)):
        s = slice(cut[i], cut[i + 1])
        g, p = gone[s], pend[s]
        raw = (texts[i] or "").encode()
        lo, hi = _merge(c.lo[s][g], c.hi[s][g]) if g.any() else (np.zeros(0, np.int64),) * 2
        # pending contexts inside removed bytes stay: later documents are compared with them
        rid.append(batch.column(0)[i].as_py())
        ids.append(batch.column(1)[i].as_py())
        marks.append(np.concatenate([lo, hi]).astype("<i8").tobytes())
        body.append(squeeze(raw))
        firsts.append(frames(squeeze(c.anchor[s][p]), squeeze(c.lo[s][p]), squeeze(c.hi[s][p]), squeeze(flag[s][p])) if p.any() else None)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rid, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(body, pa.binary()),
         pa.array(firsts, pa.binary())], ["rid", "doc_id", "marks", "body", "firsts"])


# ---------------------------------------------------------------- suffix arrays

def enhanced_suffix_array(buf: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, lcp): the suffixes that begin at ``at`` and end after ``left`` bytes, sorted, and
    the common prefix of each with the one before.  For short texts: it compares eight bytes at
    a time, over all suffixes at once."""
    if not len(at):
        return at, np.zeros(0, np.int64)
    deep = -(-int(left.max()) // 8)
    padded = np.concatenate([buf, np.zeros(8 * deep + 8, np.uint8)])
    view = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    words = []
    for k in range(deep):
        short = np.clip(8 * (8 * (k + 1) - left), 0, 64).astype(U)  # bits past the end
        word = view[at + 8 * k].astype(U)
        words.append(np.where(short < U(64), word >> (short & U(63)) << (short & U(63)), U(0)))
    order = np.lexsort([left, *words[::-1]])
    sa, left = at[order], left[order]
    lcp, same = np.zeros(len(sa), np.int64), np.ones(len(sa) - 1, bool)
    for word in words:
        w = word[order]
        x = w[1:] ^ w[:-1]
        # equal leading bytes: 8 minus the bytes up to the highest set bit
        got = np.where(x == 0, 8, 8 - -(-_bit_length(x) // 8))
        lcp[1:] += np.where(same, got, 0)
        same &= x == 0
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
    return sa, lcp


def _bit_length(x: np.ndarray) -> np.ndarray:
    high, low = (x >> U(32)).astype(np.float64), (x & U(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def lcp_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the common-prefix tree at least ``least`` deep,
    by the stack scan over the LCP array."""
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*lcp.tolist()[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if d >= least and (not stack or stack[-1][0] < d):
            stack.append((d, first))


def maximal_repeats(buf: np.ndarray, begin: np.ndarray, stop: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every repeat of ``least`` bytes or more that no longer repeat replaces: its occurrences have
    different bytes, or a text's begin, to their left.  Gives batches of repeats as (lengths,
    bounds, places): repeat k has length ``lengths[k]`` and places ``places[bounds[k]:bounds[k+1]]``.

    Suffixes whose first ``least`` bytes occur once are in no interval and are left out first.
    """
    at = np.flatnonzero(stop - np.arange(len(buf)) >= least)
    at = at[tn.repeated(tn.rolling(buf, least)[at])] if len(at) else at
    sa, lcp = enhanced_suffix_array(buf, at, stop[at] - at)
    if not len(sa):
        return
    before = np.where(sa == begin[sa], 256 + np.arange(len(sa)), buf[np.maximum(sa - 1, 0)].astype(np.int64))
    # runs of neighbours that share ``least`` bytes; one kind of byte to the left: nothing maximal
    head = np.flatnonzero(lcp < least)
    size = np.diff(np.append(head, len(sa)))
    diverse = (np.minimum.reduceat(before, head) != np.maximum.reduceat(before, head)) & (size > 1)
    two = head[diverse & (size == 2)]
    yield lcp[two + 1], np.arange(len(two) + 1) * 2, sa[(two[:, None] + np.arange(2)).ravel()]
    lengths, sizes, places = [], [], []
    for lo, n in zip(head[diverse & (size > 2)].tolist(), size[diverse & (size > 2)].tolist()):
        part = lcp[lo:lo + n].copy()
        part[0] = 0
        for depth, i, j in lcp_intervals(part, least):
            b = before[lo + i:lo + j + 1]
            if (b != b[0]).any():
                lengths.append(depth)
                sizes.append(j - i + 1)
                places.append(sa[lo + i:lo + j + 1])
    if lengths:
        yield np.array(lengths), np.cumsum([0, *sizes]), np.concatenate(places)


def _contexts_out(bits: int):
    """Pending contexts as rows (bucket, body) with rid, document, place and text packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[int, list] = {}
            for rid, doc, body, firsts in zip(*(c.to_pylist() for c in b.columns)):
                raw = unsqueeze(body)
                a, lo, hi, flag = (unsqueeze(x) for x in unframe(firsts))
                a, lo, hi = np.frombuffer(a, U), np.frombuffer(lo, np.int64), np.frombuffer(hi, np.int64)
                near = (np.frombuffer(flag, np.uint8) & APART) > 0
                doc = NULL_ID if doc is None else doc
                for k, s, e in zip((a[near] >> U(64 - bits)).tolist(), lo[near].tolist(), hi[near].tolist()):
                    rows.setdefault(k, []).append((rid, doc, s, raw[s:e]))
            for k, got in rows.items():
                head = np.array([(r, d, s, len(t)) for r, d, s, t in got], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([frames(squeeze(np.ascontiguousarray(head.T)), squeeze(b"".join(t for *_, t in got)))], pa.binary())],
                    ["bucket", "body"])

    return run


def _compare(t: pa.Table) -> pa.Table:
    """Byte ranges that the repeats of a bucket remove."""
    heads, texts = [], []
    for raw in t.column("body").to_pylist():
        h, x = unframe(raw)
        heads.append(np.frombuffer(unsqueeze(h), np.int64).reshape(4, -1))
        texts.append(np.frombuffer(unsqueeze(x), np.uint8))
    rid, doc, place, size = np.concatenate(heads, axis=1)
    buf = np.concatenate(texts)
    end = np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    out: list[list[np.ndarray]] = [[], [], []]
    for lengths, bounds, at in maximal_repeats(buf, (end - size)[of], end[of], LENGTH):
        if not len(lengths):
            continue
        k = of[at]
        n = np.diff(bounds)
        gone = doc[k] > np.repeat(np.minimum.reduceat(doc[k], bounds[:-1]), n)
        k = k[gone]
        start = at[gone] - (end - size)[k] + place[k]
        for col, val in zip(out, (rid[k], start, start + np.repeat(lengths, n)[gone])):
            col.append(val)
    cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.table([pa.array(c) for c in _merge_by(*cols)], ["rid", "lo", "hi"])


def _merge_by(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of byte ranges within each row."""
    if not len(rid):
        return rid, lo, hi
    order = np.lexsort((lo, rid))
    rid, lo, hi = rid[order], lo[order], hi[order]
    base = np.cumsum(np.append(False, rid[1:] != rid[:-1])) << 33
    far = np.maximum.accumulate(hi + base)
    head = np.flatnonzero(np.append(True, (lo + base)[1:] > far[:-1]))
    return rid[head], lo[head], far[np.append(head[1:], len(rid)) - 1] - base[head]


def _windows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 50-byte strings of pending contexts of very wide anchors, by hash."""
    for b in batches:
        for rid, doc, body, firsts in zip(*(c.to_pylist() for c in b.columns)):
            raw = np.frombuffer(unsqueeze(body), np.uint8)
            a, lo, hi, flag = (unsqueeze(x) for x in unframe(firsts))
            lo, hi = np.frombuffer(lo, np.int64), np.frombuffer(hi, np.int64)
            far = (np.frombuffer(flag, np.uint8) & FAR) > 0
            n = np.maximum(hi[far] - lo[far] - LENGTH + 1, 0)
            at = np.unique(np.repeat(lo[far], n) + tn.ragged(n))
            if len(at):
                h1 = tn.span_hash(raw, at, at + LENGTH, tn.BYTE_CODE)
                h2 = tn.span_hash(raw, at, at + LENGTH, tn.BYTE_CODE[::-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.full(len(at), rid)),
                     pa.array(np.full(len(at), NULL_ID if doc is None else doc)), pa.array(at)], ["h1", "h2", "rid", "doc", "lo"])


def _finish(docs: pa.Table, marks: pa.Table) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    for doc, raw, body in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "marks", "body"))):
        text = unsqueeze(body)
        lo, hi = np.frombuffer(raw, "<i8").reshape(2, -1)
        lo = np.concatenate([lo, marks.column("lo").to_numpy()])
        hi = np.concatenate([hi, marks.column("hi").to_numpy()])
        kept = text
        if len(lo):
            lo, hi = _merge(lo, hi)
            edge = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2]))
        for col, val in zip(out, (doc, len(text), len(text) - len(kept), len(lo), _digest(kept))):
            col.append(val)
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, and the digest of what is left."""
    packs = pack(docs, "repeat-packs", id_col, text_col)
    bits = bucket_bits(packs)
    shared = answer(ask(packs, bits, _ask_shared(bits)), _shared)
    opened = stage(join_replies(packs, shared, _open(bits), "block long, part int, payload binary, closed binary"), "repeat-open")
    live = opened.filter("payload is not null")
    classes = answer(ask(live, bits, _ask_classes), _classes(wide))
    marked = stage(join_replies(live, classes, _apply, MARKED), "repeat-marks")
    pending = marked.filter("firsts is not null").select("rid", "doc_id", "body", "firsts")
    near = pending.mapInArrow(_contexts_out(bits + 3), "bucket int, body binary") \
        .groupBy("bucket").applyInArrow(_compare, "rid long, lo long, hi long")
    rows = stage(pending.mapInArrow(_windows_out, "h1 long, h2 long, rid long, doc long, lo long"), "repeat-windows")
    low = rows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    far = rows.join(low, ["h1", "h2"]).filter("doc > low").select("rid", "lo", (F.col("lo") + LENGTH).alias("hi"))
    more = near.unionByName(far)
    done = marked.select("rid", "doc_id", "marks", "body").groupBy("rid").cogroup(more.groupBy("rid")) \
        .applyInArrow(_finish, RESULT)
    return done.unionByName(opened.select("closed").mapInArrow(_closed, RESULT))

