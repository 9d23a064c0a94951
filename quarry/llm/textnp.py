"""Vectorised text helpers used inside Arrow tasks: tokenising, span hashes, n-grams.

All functions work on one flat UTF-8 buffer (``uint8``) with document offsets, so a batch of
texts costs a fixed number of numpy passes.  Long texts are hashed in pieces, so the working
arrays stay bounded by ``PIECE`` plus a few words per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = _U(0xD6E8FEB86659FD93)

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BYTE_CODE_LOWER = BYTE_CODE.copy()
BYTE_CODE_LOWER[65:91] = BYTE_CODE[97:123]

#: words are runs of anything but space, \t, \n, \v, \f and \r
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, _U(base))
    out[0] = _U(1)
    return np.multiply.accumulate(out)


_POW = _powers(_P)
_IPOW = _powers(_PINV)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off_buf, data = column.buffers()
    if n == 0 or off_buf is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off_buf, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes (one row at least)."""
    _, offs = flat(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Rolling-hash value of each ``buf[start:end]`` (equal bytes give equal values)."""
    n = len(buf)
    at_s, at_e = np.zeros(len(start), _U), np.zeros(len(start), _U)
    inv = np.empty(len(start), _U)
    order_e = None if np.all(end[1:] >= end[:-1]) else np.argsort(end, kind="stable")
    es = end if order_e is None else end[order_e]
    carry, res_e = 0, np.zeros(len(start), _U)
    for a in range(0, max(n, 1), PIECE):
        b = min(n, a + PIECE)
        scale, iscale = _U(pow(_P, a, 1 << 64)), _U(pow(_PINV, a, 1 << 64))
        cum = np.zeros(b - a + 1, _U)
        np.cumsum(code[buf[a:b]] * _POW[:b - a], out=cum[1:])
        cum = cum * scale + _U(carry)
        i, j = np.searchsorted(start, [a, b if b < n else n + 1])
        at_s[i:j] = cum[start[i:j] - a]
        inv[i:j] = _IPOW[start[i:j] - a] * iscale
        i, j = np.searchsorted(es, [a, b], side="right")
        if a == 0:
            i = 0
        res_e[i:j] = cum[es[i:j] - a]
        carry = int(cum[-1])
    if order_e is None:
        at_e = res_e
    else:
        at_e[order_e] = res_e
    return mix((at_e - at_s) * inv + (end - start).astype(_U))


def rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every place on (equal bytes give equal values)."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, step = np.empty(n, _U), min(PIECE - width, 1 << 16)
    for a in range(0, n, step):
        b = min(n, a + step)
        cum = np.zeros(b - a + width, _U)
        np.cumsum(BYTE_CODE[buf[a:b + width - 1]] * _POW[:b - a + width - 1], out=cum[1:])
        out[a:b] = mix((cum[width:] - cum[:b - a]) * _IPOW[:b - a])
    return out


class Words:
    """Words of a batch: byte spans, hashes and the index of each text's first word."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, start, end, hashes, first):
        self.start, self.end, self.hash, self.first = start, end, hashes, first

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of ``mask`` inside each text."""
    n = len(mask)
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    cut = offs[:-1][offs[:-1] < n]
    before[cut] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    last = cut[cut > 0] - 1
    after[last] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def tokenize(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> Words:
    start, end = runs(IS_WORD[buf], offs)
    h = span_hash(buf, start, end, BYTE_CODE_LOWER if lower else BYTE_CODE)
    return Words(start, end, h, np.searchsorted(start, offs))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of every window of ``n`` words inside a text, and the window's first word."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    acc = words.hash[:total - n + 1].copy()
    for k in range(1, n):
        acc = acc * _Q + words.hash[k:total - n + 1 + k]
    limit = np.repeat(words.first[1:], words.counts())[:total - n + 1]
    at = np.flatnonzero(np.arange(total - n + 1) + n <= limit)
    return mix(acc[at] + _U(n)), at


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (by sorting, which beats hashing on large arrays)."""
    s = np.sort(x)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the index in them of each value (by hashing, for values that repeat often)."""
    d = pa.array(x).dictionary_encode()
    values = d.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[d.indices.to_numpy()]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    s = np.sort(keys)
    dup = distinct(s[1:][s[1:] == s[:-1]])
    if not len(dup):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(dup, keys)
    at[at == len(dup)] = 0
    return dup[at] == keys


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in ``lengths``, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first, lengths)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``bounds``."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]
