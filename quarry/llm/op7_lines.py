"""Line dedup by an exact set-similarity join.

A line is a newline-separated piece of a text with at least one word; its set holds its distinct
words (A-Z lower-cased).  A line goes if an earlier line, in the order of (document id, line
number), has a Jaccard similarity of ``NUM / DEN`` or more with it.

1. Texts are read into words once: a block is kept as its line sets, coded by its vocabulary.
   Equal sets of a block form one member, named by its first line; its other lines go at once.
   Members with equal sets (by 128-bit signature) in several blocks go but for the first.
2. Rarity: a bulk exchange counts the members of every word over the corpus; sets sort by
   (log-scaled count, hash), rarest first.  A word of one member meets nothing.
3. Candidates meet on prefix tokens: similar sets share one of their first
   ``n - ceil(NUM n / DEN) + 1`` tokens.  Very frequent tokens (``HOT``) meet only in pairs: one
   token further, similar sets share two prefix tokens, so either a rarer one or a pair of
   frequent ones.  Inside a group the length filter, the positional filter and a parity sketch
   (which bounds the symmetric difference from below) prune; members are compared with the
   earliest first and stop at ``FIRST`` candidates, so a large group of near copies costs about
   its size.  Sets so small that only equal ones are similar need no search.
4. Candidates are verified on the full sets, in rounds: of each member first the one nearest by sketch, over all its
   groups; then, for members still undecided, the others; then, for those that stopped early and failed on
   all, every earlier member of the groups in which they stopped.

Defined results: null or empty texts have no lines; a null id sorts first; rows that repeat an
id order by where they are read, so the second copy's lines go; lines without a word stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .op8_ngram_join import _levels, _overlap, _short
from .packs import (answer, ask, bucket_bits, bucket_cuts, frames, get_counts, get_u32, get_u64, join_replies, pack,
                    put_counts, put_u32, put_u64, squeeze, unframe, unseal, unsqueeze)
from .staging import stage

NUM, DEN = 4, 5
HOT = 4 * 16  # log-scaled count of 2^16
FIRST = 8
CELL_BYTES = 8 << 20
# sketch words by the size of a set: 64 bits up to the first, 128 up to the second, then 512
ONE_WORD, TWO_WORDS = 72, 180
PIECE = 1 << 18
IDX = 28  # bits of a member id that number its first line inside its block
NULL_ID = -(1 << 63)
U = np.uint64


def _line_of(buf: np.ndarray, offs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line with a word: its first word, its text, and how many line breaks of that text come before it."""
    stop = np.flatnonzero(buf == 10)
    first = tn.distinct(np.searchsorted(start, np.concatenate([stop, offs[:-1]])))
    first = first[first < len(start)]
    row = np.searchsorted(offs, start[first], side="right") - 1
    no = np.searchsorted(stop, start[first]) - np.searchsorted(stop, offs[:-1])[row]
    return first, row, no


def _classes(least: np.ndarray, most: np.ndarray):
    """(places, words compared, words kept) of pairs by the words that their smaller and larger set keep."""
    kept = [1 + (x > ONE_WORD) + 6 * (x > TWO_WORDS) for x in (least, most)]
    for few, many in ((1, 1), (1, 2), (1, 8), (2, 2), (2, 8), (8, 8)):
        at = np.flatnonzero((kept[0] == few) & (kept[1] == many))
        if len(at):
            yield at, few, many


class Lines:
    """The line sets of a block.  Of each document ``ids`` and ``nulls``; of each line with a word its document
    ``row``, its number ``no`` and its ``member_of``; of each member its first line ``head``, the ``size`` of its set
    and, one after the other, the ``code`` of its words in the sorted ``vocab``."""

    def __init__(self, batch: pa.RecordBatch):
        if "text" not in batch.schema.names:
            f = unframe(batch.column(1)[0].as_py())
            self.ids, self.nulls = get_ids(f[0]), np.frombuffer(unsqueeze(f[1]), bool)
            self.row, self.no, self.member_of, self.head, self.size, step = (get_counts(x) for x in f[2:8])
            self.vocab = get_u64(f[8])
            code, start = np.cumsum(step), self.start()
            self.code = code - np.repeat(code[start] - step[start], self.size)
            return
        col = batch.column(2)
        self.nulls = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        self.ids = batch.column(1).fill_null(NULL_ID).to_numpy()
        words, first, line_row, line_no, n = [], [], [], [], 0
        for lo, hi in tn.chunks(col):
            buf, offs = tn.flat(col.slice(lo, hi - lo))
            w = tn.tokenize(buf, offs)
            at, row, no = _line_of(buf, offs, w.start)
            words.append(w.hash)
            first.append(at + n)
            line_row.append(row + lo)
            line_no.append(no)
            n += len(w.hash)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.vocab, tok = tn.coded(cat(words, U))
        self.row, self.no, first = cat(line_row, np.int64), cat(line_no, np.int64), cat(first, np.int64)
        total = len(first)
        key = tn.distinct(np.repeat(np.arange(total), np.diff(np.append(first, n))) << 32 | tok)
        bound, code = np.searchsorted(key >> 32, np.arange(total + 1)), key & 0xFFFFFFFF
        h = self._signs(code, bound[:-1])
        order = np.lexsort((self.no, self.row, self.ids[self.row], h[1], h[0]))
        a, b = h[0][order], h[1][order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if total else np.zeros(0, bool)
        self.member_of = np.empty(total, np.int64)
        self.member_of[order] = np.cumsum(new) - 1
        self.head = order[new]
        self.size = np.diff(bound)[self.head]
        self.code = code[np.repeat(bound[:-1][self.head], self.size) + tn.ragged(self.size)]

    def _signs(self, code: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        return [np.add.reduceat(tn.mix(self.vocab ^ U(s))[code], start) if len(start) else np.zeros(0, U)
                for s in (0, 0x5851F42D4C957F2D)]

    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def signs(self) -> list[np.ndarray]:
        """128 bits of each member that tell its set."""
        return self._signs(self.code, self.start())

    def sketches(self) -> list[np.ndarray]:
        """Parity sketches: each word flips one of 512 bits; the bits in which two sketches differ are at most
        the words in which the sets differ.  Smaller sets keep it folded to fewer words of 64 bits."""
        start, out = self.start(), [np.zeros(len(self.size), U) for _ in range(8)]
        one, word = U(1) << (self.vocab & U(63)), (self.vocab >> U(6)) & U(7)
        for m, kept, _ in _classes(self.size, self.size):
            n = self.size[m]
            code = self.code[np.repeat(start[m], n) + tn.ragged(n)]
            for k in range(kept):
                out[k][m] = np.bitwise_xor.reduceat(np.where(word % U(kept) == U(k), one, U(0))[code], np.cumsum(n) - n)
        return out


def _kept(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A block as ``Lines`` reads it back; the first column names the block."""
    x = Lines(batch)
    step = np.diff(x.code, prepend=0)  # codes of a set ascend
    step[x.start()] = x.code[x.start()]
    body = frames(put_ids(x.ids), squeeze(x.nulls), *(put_counts(c) for c in (x.row, x.no, x.member_of, x.head, x.size, step)),
                  put_u64(x.vocab))
    return pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([body], pa.binary())], ["rid", "lines"])


class Members:
    """Distinct line sets of a block: sorted tokens by rarity, first line, and each line's member."""

    def __init__(self, batch: pa.RecordBatch, level_of):
        x = Lines(batch)
        self.ids, self.nulls, self.line_row, self.line_no, self.member_of = x.ids, x.nulls, x.row, x.no, x.member_of
        self.head, self.size, self.start = x.head, x.size, x.start()
        self.doc = x.ids[x.row[x.head]]
        level = level_of(x.vocab)
        order = np.lexsort((x.vocab, level))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_rank = order[np.sort(np.repeat(np.arange(len(x.size)), x.size) << 32 | rank[x.code]) & 0xFFFFFFFF]
        self.token, self.level = x.vocab[by_rank], level.astype(np.int64)[by_rank]
        self.map, self.sign = x.sketches(), x.signs()

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, member, place): what the members meet on.  At the first common key of two similar sets, no more
        than ``n - place`` tokens can be common; a pair of tokens has the place before its second."""
        upto = np.minimum(self.size, self.size + (-NUM * self.size // DEN) + 2)  # the prefix and one more
        n = np.repeat(self.size, upto)
        of, place = np.repeat(np.arange(len(self.size)), upto), tn.ragged(upto)
        reach = n + (-NUM * n // DEN) + 1
        at_token = np.repeat(self.start, upto) + place
        token, level = self.token[at_token], self.level[at_token]
        hot = level >= HOT
        wide = np.zeros(len(self.size), bool)
        wide[of[hot & (place <= reach) & (n > 1)]] = True
        # a set with no room for one token more is similar to equal sets only
        inside = (place < reach + wide[of]) & (level > 0) & (n * DEN // NUM > n)
        single = inside & ~hot & (n > 1)
        keys, who, at = [tn.mix(token[single])], [of[single]], [place[single]]
        # pairs of frequent tokens
        f = np.flatnonzero(inside & hot & (n > 1))
        count = np.bincount(of[f], minlength=len(self.size))
        left = np.repeat(np.cumsum(count), count) - np.arange(len(f)) - 1
        x = np.repeat(f, left)
        y = f[np.repeat(np.arange(len(f)), left) + 1 + tn.ragged(left)] if len(f) else f
        keys.append(tn.mix(token[x] * U(0xD6E8FEB86659FD93) + token[y]))
        who.append(of[x])
        at.append(place[y] - 1)
        return np.concatenate(keys), np.concatenate(who), np.concatenate(at)


def _ask_words(bits: int):
    def keys_of(batch: pa.RecordBatch):
        x = Lines(batch)
        short = _short(x.vocab, bits)
        head = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.zeros(0, np.int64)
        members = np.bincount(x.code, minlength=len(x.vocab))
        count = np.minimum(np.add.reduceat(members, head), 65535).astype("<u2") if len(head) else np.zeros(0, "<u2")
        keys = short[head]
        low = (keys << U(bits) >> U(32)).astype(np.uint32)
        return keys, lambda a, b: frames(squeeze(count[a:b]), put_u32(low[a:b]))

    return keys_of


def _level_lookup(batch: pa.RecordBatch, replies: list[bytes], bits: int):
    level = np.concatenate([np.frombuffer(unsqueeze(r), np.uint8) for r in replies]) if replies else np.zeros(0, np.uint8)

    def of(vocab: np.ndarray) -> np.ndarray:
        short = _short(vocab, bits)
        return level[np.searchsorted(tn.distinct(short), short)]

    return of


def block_number(block: int, width: int) -> int:
    """A block's number; ``width`` is the number of the input's partitions."""
    return ((block >> 20) & 0xFFFFF) * width + (block >> 40)


def _numbers(packs: DataFrame) -> tuple[int, F.Column]:
    """``width`` for ``block_number``, and the same number as a column."""
    seq, part = F.shiftright("block", 20).bitwiseAND(0xFFFFF), F.shiftright("block", 40)
    width, most = packs.agg(F.coalesce(F.max(part), F.lit(0)) + 1, F.coalesce(F.max(seq), F.lit(0)) + 1).first()
    if width * most >= 1 << (63 - IDX):
        raise ValueError(f"{width} partitions of up to {most} blocks have no numbers of {63 - IDX} bits")
    return width, seq * width + part


def _spread(bits: int, width: int):
    """A block's entries by bucket of their key, its members by bucket of their signature, and
    the lines of its documents; one row each for a bucket."""
    def fn(batch: pa.RecordBatch, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        m = Members(batch, _level_lookup(batch, replies, bits))
        key, who, place = m.entries()
        # inside a bucket by member: neighbours share document, line and size, which packs them small
        bucket = (key >> U(64 - bits)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        key, who, place = key[order], who[order], place[order]
        cut = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        number = block_number(batch.column(0)[0].as_py(), width)
        by_sign = np.argsort(m.sign[0])
        cut_sign = bucket_cuts(m.sign[0][by_sign], bits)
        low = (key << U(bits) >> U(32)).astype(np.uint32)  # meeting by chance is pruned later

        def body(k: int) -> bytes:
            a, b = cut[k], cut[k + 1]
            w = who[a:b]
            sign = by_sign[cut_sign[k]:cut_sign[k + 1]]
            return frames(
                number.to_bytes(8, "little"),
                put_u32(low[a:b]), put_counts(m.head[w]), put_counts(m.size[w]), put_counts(place[a:b]),
                m.map[0][w].tobytes(), m.map[1][w][m.size[w] > ONE_WORD].tobytes(), put_ids(m.doc[w]),
                b"".join(x[w][m.size[w] > TWO_WORDS].tobytes() for x in m.map[2:]),
                m.sign[0][sign].tobytes(), m.sign[1][sign].tobytes(), put_counts(m.head[sign]), put_ids(m.doc[sign]))

        buckets = range(1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([body(k) for k in buckets], pa.binary())], ["bucket", "payload"])
        rows = frames(number.to_bytes(8, "little"), put_ids(m.ids), squeeze(m.nulls),
                      put_counts(m.line_row), put_counts(m.line_no), put_counts(m.member_of), put_counts(m.head))
        yield pa.RecordBatch.from_arrays([pa.array([-1 - number % (1 << 30)], pa.int32()), pa.array([rows], pa.binary())],
                                         ["bucket", "payload"])

    return fn


def put_ids(x: np.ndarray) -> bytes:
    """Ids as byte planes, zstd."""
    return squeeze(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T))


def get_ids(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


SKETCH = [f"m{k}" for k in range(8)]


def _read_entries(payloads: list[bytes]) -> dict[str, np.ndarray]:
    """Entries of a bucket, by key, document and line; most whose key no other has are left out."""
    framed = [unframe(p) for p in payloads]
    keys = [get_u32(f[1]) for f in framed]
    shift = np.uint32(max(0, 29 - int(sum(map(len, keys))).bit_length()))
    met = np.bincount(np.concatenate(keys) >> shift) > 1
    cols: list[list[np.ndarray]] = [[] for _ in range(13)]
    for f, key in zip(framed, keys):
        n, at = get_counts(f[3]), np.flatnonzero(met[key >> shift])
        sketch = np.zeros((8, len(n)), U)
        sketch[0] = np.frombuffer(f[5], U)
        sketch[1, n > ONE_WORD] = np.frombuffer(f[6], U)
        sketch[2:, n > TWO_WORDS] = np.frombuffer(f[8], U).reshape(6, -1)
        ids = (int.from_bytes(f[0], "little") << IDX) + get_counts(f[2])[at]
        for c, v in zip(cols, (key[at], ids, n[at], get_counts(f[4])[at], get_ids(f[7])[at], *sketch[:, at])):
            c.append(v)
    return _by_key(cols)


FIELDS = ("key", "id", "n", "place", "doc", *SKETCH)


def _by_key(cols: list[list[np.ndarray]]) -> dict[str, np.ndarray]:
    e = {k: np.concatenate(c) for k, c in zip(FIELDS, cols)}
    order = np.lexsort((e["id"], e["doc"], e["key"]))
    return {k: v[order] for k, v in e.items()}


def _put_groups(e: dict[str, np.ndarray], at: np.ndarray) -> list[bytes]:
    """The entries ``at`` in pieces of ``PIECE``."""
    out = []
    for lo in range(0, len(at), PIECE):
        p = {k: v[at[lo:lo + PIECE]] for k, v in e.items()}
        out.append(frames(put_u32(p["key"]), put_ids(p["id"]), put_counts(p["n"]), put_counts(p["place"]), put_ids(p["doc"]),
                          squeeze(np.stack([p[c] for c in SKETCH]))))
    return out


def _get_groups(payloads: list[bytes]) -> dict[str, np.ndarray]:
    cols: list[list[np.ndarray]] = [[] for _ in FIELDS]
    for p in payloads:
        f = unframe(p)
        sketch = np.frombuffer(unsqueeze(f[5]), U).reshape(8, -1)
        for c, v in zip(cols, (get_u32(f[0]), get_ids(f[1]), get_counts(f[2]), get_counts(f[3]), get_ids(f[4]), *sketch)):
            c.append(v)
    return _by_key(cols)


def _repeats(payloads: list[bytes]) -> np.ndarray:
    """Members of a bucket whose set an earlier member has."""
    cols: list[list[np.ndarray]] = [[] for _ in range(4)]
    for p in payloads:
        f = unframe(p)
        ids = (int.from_bytes(f[0], "little") << IDX) + get_counts(f[11])
        for c, v in zip(cols, (np.frombuffer(f[9], U), np.frombuffer(f[10], U), get_ids(f[12]), ids)):
            c.append(v)
    a, b, doc, ids = (np.concatenate(c) for c in cols)
    order = np.lexsort((ids, doc, b, a))
    same = np.append(False, (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])) if len(a) else np.zeros(0, bool)
    return ids[order][same]


def _pass(e: dict[str, np.ndarray], y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length, positional and bitmap filter of the entries y against x: the mask of those that pass, and the
    distance of their sketches.  Similar sets pass at their first common key, where nothing before it is common;
    at later ones they need not."""
    ny, nx = e["n"][y], e["n"][x]
    ok = DEN * np.minimum(ny, nx) >= NUM * np.maximum(ny, nx)
    y, x, ny, nx = y[ok], x[ok], ny[ok], nx[ok]
    most = np.minimum(ny - e["place"][y], nx - e["place"][x])
    need = -(-NUM * (ny + nx) // (NUM + DEN))
    most[(ny == nx) & (need == ny)] = 0  # only equal sets would do, and those are known by their signature
    good = (most >= need) & (e["id"][y] != e["id"][x])
    ok[ok] = good
    y, x, ny, nx, need = (v[good] for v in (y, x, ny, nx, need))
    # the larger sketch folds to the smaller one's words
    apart = np.zeros(len(y), np.int64)
    for at, few, many in _classes(np.minimum(ny, nx), np.maximum(ny, nx)):
        yy, xx = y[at], x[at]
        word = [e[c][yy] ^ e[c][xx] for c in SKETCH[:many]]
        apart[at] = sum(np.bitwise_count(np.bitwise_xor.reduce(word[k::few])).astype(np.int64) for k in range(few))
    good = apart <= ny + nx - 2 * need
    ok[ok] = good
    return ok, apart[good]


def _candidates(t: pa.Table) -> pa.Table:
    """Per member and bucket the nearest of its first earlier candidates (``a``), the others, and the keys of the
    groups in which it stopped early; rows without ``a`` are members that repeat an earlier one.  The entries of
    groups in which one stopped early come along as ``entries``.  The lines of blocks pass through, with the
    block's number as ``b``."""
    payloads = t.column("payload").to_pylist()
    bucket = t.column("bucket")[0].as_py()
    if bucket < 0:
        number = pa.array([int.from_bytes(unframe(p)[0], "little") for p in payloads], pa.int64())
        return _rows(len(payloads), b=number, lines=pa.array(payloads, pa.binary()))
    e = _read_entries(payloads)
    k = e["key"]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.arange(len(k)) - first[group]
    found = np.zeros(len(k), np.int64)
    out: list[list[np.ndarray]] = [[], [], []]
    depth, live = 0, np.flatnonzero(rank > 0)
    # compare with the earliest of the group first; whoever has found enough drops out
    while len(live):
        width = max(1, min(64, (1 << 20) // len(live)))
        n = np.minimum(rank[live] - depth, width)
        y = np.repeat(live, n)
        x = first[group[y]] + depth + tn.ragged(n)
        for a in range(0, len(y), 1 << 20):
            yy, xx = y[a:a + (1 << 20)], x[a:a + (1 << 20)]
            ok, apart = _pass(e, yy, xx)
            yy, xx = yy[ok], xx[ok]
            # keep the first few of each entry
            nth = np.arange(len(yy)) - np.searchsorted(yy, yy) + found[yy]
            np.add.at(found, yy, 1)
            for c, v in zip(out, (yy, xx, apart)):
                c.append(v[nth < FIRST])
        depth += width
        live = live[(rank[live] > depth) & (found[live] < FIRST)]
    y, x, apart = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    gone = _repeats(payloads)
    keep = ~np.isin(e["id"][y], gone)  # what this bucket knows already
    y, x, apart = y[keep], x[keep], apart[keep]
    # one row per member: its candidates by distance, each once
    order = np.lexsort((e["id"][x], apart, e["id"][y]))
    y, x, apart = y[order], x[order], apart[order]
    b, a = e["id"][y], e["id"][x]
    again = np.lexsort((np.arange(len(b)), a, b))
    once = np.ones(len(b), bool)
    once[again[1:]] = (b[again][1:] != b[again][:-1]) | (a[again][1:] != a[again][:-1])
    y, x, apart, b, a = y[once], x[once], apart[once], b[once], a[once]
    head = np.append(True, b[1:] != b[:-1]) if len(b) else np.zeros(0, bool)
    near = np.flatnonzero(head)
    cut = pa.array(np.append(0, np.cumsum(np.diff(np.append(near, len(b))) - 1)), pa.int32())
    # groups in which a member stopped early
    stopped = np.flatnonzero(found >= FIRST)
    stopped = stopped[np.isin(e["id"][stopped], b)]
    stopped = stopped[np.argsort(e["id"][stopped], kind="stable")]
    edge = np.searchsorted(e["id"][stopped], np.append(b[near], np.iinfo(np.int64).max))
    members = _rows(len(near), bucket=pa.array(np.full(len(near), bucket), pa.int32()), b=pa.array(b[near]), a=pa.array(a[near]),
                    nb=pa.array(e["n"][y[near]]), na=pa.array(e["n"][x[near]]), apart=pa.array(apart[near], pa.int64()),
                    rest=pa.ListArray.from_arrays(cut, pa.array(a[~head])), rest_n=pa.ListArray.from_arrays(cut, pa.array(e["n"][x[~head]])),
                    more=pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(k[stopped].astype(np.int64))))
    held = _put_groups(e, np.flatnonzero(np.isin(group, group[stopped])))
    return pa.concat_tables([members, _rows(len(gone), b=pa.array(gone)), _rows(
        len(held), bucket=pa.array(np.full(len(held), bucket), pa.int32()), entries=pa.array(held, pa.binary()))])


KINDS = {"bucket": pa.int32(), "b": pa.int64(), "a": pa.int64(), "nb": pa.int64(), "na": pa.int64(), "apart": pa.int64(),
         "rest": pa.list_(pa.int64()), "rest_n": pa.list_(pa.int64()), "more": pa.list_(pa.int64()), "entries": pa.binary(),
         "lines": pa.binary()}
PAIRS = ("bucket int, b long, a long, nb long, na long, apart long, rest array<long>, rest_n array<long>, more array<long>, "
         "entries binary, lines binary")


def _rows(n: int, **cols: pa.Array) -> pa.Table:
    return pa.table([cols[c].cast(t) if c in cols else pa.nulls(n, t) for c, t in KINDS.items()], list(KINDS))


def _sets_of(batch: pa.RecordBatch, wanted: pa.Table) -> Iterator[pa.RecordBatch]:
    """The word sets of the wanted lines of a block."""
    x = Lines(batch)
    word, cut = x.vocab[x.code], np.append(0, np.cumsum(x.size))
    of = x.member_of[wanted.column("v").to_numpy() & ((1 << IDX) - 1)]
    yield pa.RecordBatch.from_arrays(
        [wanted.column("cell").combine_chunks(), wanted.column("v").combine_chunks(),
         pa.array([word[cut[k]:cut[k + 1]].tobytes() for k in of.tolist()], pa.binary())], ["cell", "v", "keys"])


def _fetch(left: pa.Table, right: pa.Table) -> pa.Table:
    out = [x for payload in left.column("payload").to_pylist() for x in _sets_of(unseal(payload), right)] if right.num_rows else []
    return pa.Table.from_batches(out) if out else pa.table(
        [pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["cell", "v", "keys"])


def _verified(pairs: DataFrame, packs: DataFrame, number: F.Column, name: str) -> DataFrame:
    """The members b that have a verified candidate a."""
    pairs = stage(pairs.select("a", "b", "na", "nb").distinct(), name)
    cells = max(8, -(-(pairs.agg(F.sum("nb")).first()[0] or 0) * 16 // CELL_BYTES))
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64("b"), F.lit(cells)).cast("int"))
    want = dealt.select("cell", F.col("b").alias("v")).unionByName(dealt.select("cell", F.col("a").alias("v"))).distinct()
    sets = packs.select(number.alias("bn"), "payload").groupBy("bn").cogroup(
        want.withColumn("bn", F.shiftright("v", IDX)).groupBy("bn")).applyInArrow(_fetch, "cell int, v long, keys binary")
    common = dealt.groupBy("cell").cogroup(sets.groupBy("cell")).applyInArrow(_overlap, "a long, b long, common long")
    good = dealt.join(common, ["a", "b"]).filter((NUM + DEN) * F.col("common") >= NUM * (F.col("na") + F.col("nb")))
    return stage(good.select("b").distinct(), name)


def _further(entries: pa.Table, asked: pa.Table) -> pa.Table:
    """Every earlier candidate of the asked members in the asked groups of a bucket, but for the ``FIRST`` that each
    group gave before.  Rows without a key name members that repeat an earlier one; that one stands for them."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    real = asked.filter(asked.column("key").is_valid())
    if real.num_rows and entries.num_rows:
        e = _get_groups(entries.column("entries").to_pylist())
        dead = np.isin(e["id"], asked.filter(asked.column("key").is_null()).column("b").to_numpy())
        want_key, want_id = real.column("key").to_numpy(), real.column("b").to_numpy()
        lo, hi = (np.searchsorted(e["key"], want_key.astype(e["key"].dtype), side) for side in ("left", "right"))
        for a, z, b in zip(lo.tolist(), hi.tolist(), want_id.tolist()):
            for y in (a + np.flatnonzero(e["id"][a:z] == b)).tolist():
                known = FIRST
                for at in range(a, y, 1 << 20):
                    x = np.arange(at, min(y, at + (1 << 20)))
                    x = x[_pass(e, np.full(len(x), y), x)[0]]
                    x, known = x[known:], max(0, known - len(x))
                    x = x[~dead[x]]
                    for c, v in zip(out, (e["id"][x], np.full(len(x), b), e["n"][x], np.full(len(x), e["n"][y]))):
                        c.append(v)
    a, b, na, nb = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    order = np.lexsort((a, b))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return pa.table([pa.array(c[new], pa.int64()) for c in (a, b, na, nb)], ["a", "b", "na", "nb"])


RESULT = "doc_id long, n_lines long, n_removed long, removed array<int>"


def _lines(rows: pa.Table, gone: pa.Table) -> pa.Table:
    """Per document of a block: its lines and those that go."""
    out: list[list] = [[], [], [], []]
    lost = gone.column("b").to_numpy() & ((1 << IDX) - 1)
    for p in rows.column("lines").to_pylist():
        f = unframe(p)
        ids, nulls = get_ids(f[1]), np.frombuffer(unsqueeze(f[2]), bool)
        row, no, member, head = (get_counts(x) for x in f[3:])
        off = np.ones(len(row), bool)
        off[head] = False  # the first line of a member stays unless an earlier one elsewhere is like it
        off[lost] = True
        n = np.bincount(row, minlength=len(ids))
        drop = [[] for _ in range(len(ids))]
        for r, k in zip(row[off].tolist(), no[off].tolist()):
            drop[r].append(k)
        out[0] += [None if z else int(k) for k, z in zip(ids, nulls)]
        out[1] += n.tolist()
        out[2] += [len(d) for d in drop]
        out[3] += drop
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_lines", "n_removed", "removed"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: lines with a word, lines that go, and their numbers (from 0)."""
    packs = pack(docs, "line-packs", id_col, text_col, level=1, as_kept=_kept)
    bits = bucket_bits(packs)
    width, number = _numbers(packs)
    levels = answer(ask(packs, bits, _ask_words(bits)), _levels)
    entries = join_replies(packs, levels, _spread(bits, width), "bucket int, payload binary")
    found = stage(entries.groupBy("bucket").applyInArrow(_candidates, PAIRS), "line-found")
    gone = found.filter("b is not null and a is null and lines is null").select("b")
    cands = found.filter("a is not null").drop("entries", "lines").join(gone, "b", "left_anti")

    nearest = cands.groupBy("b").agg(F.min_by(F.struct("a", "na", "nb"), F.struct("apart", "a")).alias("p")).select("b", "p.*")
    near = _verified(nearest, packs, number, "line-nearest")
    left = stage(cands.join(near, "b", "left_anti"), "line-left")
    others = left.select("b", "nb", F.explode(F.concat(F.array(F.struct("a", F.col("na").alias("n"))), F.transform(
        F.arrays_zip("rest", "rest_n"), lambda z: F.struct(z["rest"].alias("a"), z["rest_n"].alias("n"))))).alias("p"))
    repeats = gone.select(F.col("b").alias("a"))  # the first of equal members stands for the others
    others = others.select("b", "nb", "p.a", F.col("p.n").alias("na")).join(nearest.select("a", "b"), ["a", "b"], "left_anti") \
        .join(repeats, "a", "left_anti")
    gone = gone.unionByName(near)
    if left.limit(1).count():
        near = _verified(others, packs, number, "line-others")
        gone = gone.unionByName(near)
        open_ = stage(left.filter(F.size("more") > 0).join(near, "b", "left_anti")
                      .select("bucket", "b", F.explode("more").alias("key")).distinct(), "line-open")
        if open_.limit(1).count():
            dead = found.filter("a is not null").select("bucket", "b").join(repeats.withColumnRenamed("a", "b"), "b", "left_semi")
            asked = open_.select("bucket", "b", "key").unionByName(dead.select("bucket", "b", F.lit(None).cast("long").alias("key")))
            held = found.filter("entries is not null").select("bucket", "entries")
            last = held.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(
                _further, "a long, b long, na long, nb long")
            gone = gone.unionByName(_verified(last, packs, number, "line-further"))
    rows = found.filter("lines is not null").select(F.col("b").alias("bn"), "lines")
    return rows.groupBy("bn").cogroup(gone.distinct().withColumn("bn", F.shiftright("b", IDX)).groupBy("bn")).applyInArrow(_lines, RESULT)
