"""Token-ID output as patched frame-of-reference blocks.

Writing: documents are range-partitioned by id, so shard k holds the k-th range in ascending
order.  Inside a shard, whole documents are gathered into segments of about ``SEGMENT`` ids;
a segment is one row of the output table and its ``payload`` is the binary record below.

    header   4 bytes "PFB1", u32 number of ids, u32 number of blocks
    index    u32 per block: where the block starts, counted from the end of the index
    block    u32 minimum, u8 width, u16 number of exceptions,
             the low ``width`` bits of (id - minimum), LSB first, padded to a byte,
             u8 position per exception, u32 (id - minimum) >> width per exception

Blocks hold ``BLOCK`` ids.  The width is the number of bits that the 90th percentile of
(id - minimum) needs; larger values keep their high bits in the exception list.  Beside the
payload a row has the shard, its place, its ids' count and the documents' ids and lengths, so
a reader can prune rows by document and, with the index, open single blocks.

Encoding: a text is cut before single spaces that stand between two non-space characters.  The
byte-level pre-tokenizer always splits there, so encoding the distinct pieces once with the
tokenizer and joining their ids gives the ids of the whole text.  A bounded cache per worker
keeps the ids of pieces already encoded, by 64-bit hash.

Defined results: a null or empty text is the end id alone; the literal of a special token is that
token's id, as the library gives it; null ids come first; rows with equal ids follow each other by
text; an empty table writes an empty output.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textnp as tn
from .staging import stage

BLOCK = 128
SEGMENT = 1 << 16
PERCENTILE = 0.9
END_ID = 2
CACHE = 2_000_000
CHUNK = 2 << 20
MAGIC = b"PFB1"

SHARD_SCHEMA = ("shard int, seq int, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
                "payload binary")


# ---------------------------------------------------------------- codec

def _bits(x: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack_bits(vals: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values as rows of bytes, ``width`` bits each, lowest bit first."""
    pos = np.arange(BLOCK) * width
    word, shift = pos >> 6, (pos & 63).astype(np.uint64)
    v = vals.astype(np.uint64)
    low = v << shift
    out = np.bitwise_or.reduceat(low, np.searchsorted(word, np.arange(BLOCK * width >> 6)), axis=1)
    split = np.flatnonzero((pos & 63) + width > 64)
    if len(split):
        out[:, word[split] + 1] |= v[:, split] >> (np.uint64(64) - shift[split])
    return out.astype("<u8").view(np.uint8)


def encode_blocks(ids: np.ndarray) -> bytes:
    """The binary record of a segment."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    head = MAGIC + np.array([n, n_blocks], "<u4").tobytes()
    if not n:
        return head
    full = np.concatenate([ids, np.full(n_blocks * BLOCK - n, ids[-1])]).astype(np.int64).reshape(n_blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bits(np.partition(rest, rank, axis=1)[:, rank])
    mask = (np.int64(1) << width) - 1
    over = rest >> width[:, None]
    row, place = np.nonzero(over)
    n_exc = np.bincount(row, minlength=n_blocks)
    size = 7 + width * (BLOCK // 8) + 5 * n_exc
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)

    def put(where: np.ndarray, what: np.ndarray, n_bytes: int) -> None:
        for k in range(n_bytes):
            out[where + k] = (what >> (8 * k)) & 0xFF

    put(at, low, 4)
    put(at + 4, width, 1)
    put(at + 5, n_exc, 2)
    for wd in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == wd)
        packed = _pack_bits(rest[rows] & mask[rows, None], wd)
        out[(at[rows] + 7)[:, None] + np.arange(packed.shape[1])] = packed
    nth = tn.ragged(n_exc)
    tail = at[row] + 7 + width[row] * (BLOCK // 8)
    put(tail + nth, place, 1)
    put(tail + n_exc[row] + 4 * nth, over[row, place], 4)
    return head + at.astype("<u4").tobytes() + out.tobytes()


def decode_blocks(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block record")
    n, n_blocks = (int(x) for x in np.frombuffer(payload, "<u4", 2, 4))
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    base = 12 + 4 * n_blocks
    at = np.frombuffer(payload, "<u4", n_blocks, 12).astype(np.int64) + base

    def num(pos: np.ndarray, size: int) -> np.ndarray:
        return sum(raw[pos + k].astype(np.int64) << (8 * k) for k in range(size))

    low, width, n_exc = num(at, 4), raw[at + 4].astype(np.int64), num(at + 5, 2)
    # every value sits inside the eight bytes at its first bit's byte
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray(len(raw) + 1, "<u8", wide, strides=(1,))
    bit = np.arange(BLOCK)[None, :] * width[:, None]
    mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    got = words[np.minimum((at + 7)[:, None] + (bit >> 3), len(raw))] >> (bit & 7).astype(np.uint64)
    out = (got & mask[:, None]).astype(np.int64)
    has = np.flatnonzero(n_exc)
    k = tn.ragged(n_exc[has])
    blk = np.repeat(has, n_exc[has])
    start = at[blk] + 7 + width[blk] * BLOCK // 8
    place = raw[start + k].astype(np.int64)
    out[blk, place] += num(start + n_exc[blk] + 4 * k, 4) << width[blk]
    return (out + low[:, None]).reshape(-1)[:n].astype(np.uint32)


# ---------------------------------------------------------------- encoder

#: lead bytes of characters that may be white space
_MAYBE_SPACE = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))


class PieceEncoder:
    """Encodes texts by their distinct pieces; see the module text for why that is exact."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        # ids whose bytes begin with a space (the byte-level alphabet writes it as U+0120)
        self.opens = np.array([(self.tok.id_to_token(k) or "").startswith("\u0120") for k in range(size)])
        (self.line,) = self.tok.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        """Known pieces: sorted hashes, and where each one's ids are."""
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros((2, 0), np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes new pieces (spans of ``buf``) and adds them."""
        size = end - start
        # pieces without white space or control bytes, but for one leading space, are encoded
        # many at a time: ids that begin with a space, or line breaks put between, part them
        text = buf[np.repeat(start, size) + tn.ragged(size)]
        cut = np.append(0, np.cumsum(size))
        odd = (text < 0x21) | (text == 0x7F) | (text == 0xC2) | ((text >= 0xE1) & (text <= 0xE3))
        n_odd, led = tn.sums(odd, cut), text[cut[:-1]] == 0x20
        flat, lens = [], np.zeros(len(size), np.int64)
        plain, bare = np.flatnonzero(led & (n_odd == 1)), np.flatnonzero(n_odd == 0)
        for run in (plain, bare):
            for a in range(0, len(run), 4096):
                part = run[a:a + 4096]
                if run is plain:
                    n = size[part]
                    raw = text[np.repeat(cut[part], n) + tn.ragged(n)].tobytes()
                else:
                    raw = b"\n".join(text[cut[k]:cut[k + 1]].tobytes() for k in part.tolist())
                ids = np.array(self.tok.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)
                if run is plain:
                    first = np.append(np.flatnonzero(self.opens[ids]), len(ids))
                else:
                    breaks = ids == self.line
                    first = np.append(0, np.cumsum(~breaks)[breaks])
                    ids = ids[~breaks]
                    first = np.append(first, len(ids))
                if len(first) != len(part) + 1:
                    raise ValueError("the tokenizer does not split where it should")
                lens[part] = np.diff(first)
                flat.append(ids)
        rest = np.setdiff1d(np.arange(len(size)), np.concatenate([plain, bare]))
        for k in rest.tolist():
            ids = self.tok.encode(text[cut[k]:cut[k + 1]].tobytes().decode(), add_special_tokens=False).ids
            lens[k] = len(ids)
            flat.append(np.array(ids, np.uint32))
        order = np.concatenate([plain, bare, rest])
        begin = np.empty(len(size), np.int64)
        begin[order] = len(self.ids) + np.cumsum(lens[order]) - lens[order]
        self.ids = np.concatenate([self.ids, *flat])
        at = np.searchsorted(self.known, hashes)  # both sorted
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, np.stack([begin, lens]), axis=1)

    @staticmethod
    def cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Places that always part two pieces: before a space, and around a line break, that
        stands alone between two characters that are not white space."""
        if len(buf) < 3:
            return np.zeros(0, np.int64)
        at = np.flatnonzero((buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A)) + 1
        nxt, prv, two = buf[at + 1], buf[at - 1], buf[np.maximum(at - 2, 0)]
        # a neighbour is surely not white space if it is printable ASCII, or a lead byte that
        # begins no white space character (before: the end of a two-byte character from U+00C0)
        after = (nxt > 0x20) & (nxt != 0x7F) & ~_MAYBE_SPACE[nxt]
        before = ((prv > 0x20) & (prv < 0x7F)) | ((prv >= 0x80) & (two >= 0xC3) & (two <= 0xDF))
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True  # neighbours in another text do not count
        at = at[after & before & ~edge[at] & ~edge[at + 1]]
        return np.concatenate([at, at[buf[at] == 0x0A] + 1])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end id per text, ids per text)."""
        buf, offs = tn.flat(column)
        edges = np.sort(np.concatenate([self.cuts(buf, offs), offs]))
        edges = edges[np.append(True, edges[1:] != edges[:-1])]
        start, end = edges[:-1], edges[1:]
        uniq, first, piece = np.unique(tn.span_hash(buf, start, end, tn.BYTE_CODE), return_index=True, return_inverse=True)
        if len(self.known) + len(uniq) > CACHE:
            self.clear()
        at = np.searchsorted(self.known, uniq)
        new = np.append(self.known, np.uint64(0))[at] != uniq
        new |= at == len(self.known)
        if new.any():
            self._learn(uniq[new], buf, start[first[new]], end[first[new]])
        where, lens = self.place[:, np.searchsorted(self.known, uniq)][:, piece]
        # a text is its pieces and one end id
        doc = np.searchsorted(offs, start, side="right") - 1
        per = np.bincount(doc, weights=lens, minlength=len(column)).astype(np.int64) + 1
        total = int(per.sum())
        out = np.full(total, END_ID, np.uint32)
        src = np.repeat(where, lens) + tn.ragged(lens)
        dst = np.arange(len(src)) + np.repeat(doc, lens)
        out[dst] = self.ids[src]
        return out, per


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """One encoder per worker process, kept between its tasks."""
    return PieceEncoder(path)


# ---------------------------------------------------------------- write and read

def _segments(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        enc = _encoder(path)
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size, seq
            ids = np.concatenate([h[1] for h in held])
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
                pa.array([[x for h in held for x in h[0]]], pa.list_(pa.int64())),
                pa.array([np.concatenate([h[2] for h in held])], pa.list_(pa.int64())),
                pa.array([encode_blocks(ids)], pa.binary())],
                ["shard", "seq", "n_ids", "doc_ids", "doc_lengths", "payload"])
            held, size, seq = [], 0, seq + 1
            return row

        for b in batches:
            for lo, hi in tn.chunks(b.column(1), CHUNK):
                keys = b.column(0).slice(lo, hi - lo).to_pylist()
                ids, per = enc(b.column(1).slice(lo, hi - lo))
                ends = np.cumsum(per)
                first = 0
                while first < len(per):
                    done = ends[first - 1] if first else 0
                    last = int(np.searchsorted(ends, done + SEGMENT - size, side="right"))
                    last = min(max(last, first + (not held)), len(per))
                    if last > first:
                        held.append((keys[first:last], ids[done:ends[last - 1]], per[first:last]))
                        size += int(ends[last - 1] - done)
                        first = last
                    if size >= SEGMENT or first < len(per):
                        yield flush()
        if held:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids to the shared folder and returns the written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    return stage(parts.mapInArrow(_segments(tokenizer), SHARD_SCHEMA), "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """Per document, from the written payloads: place, ids' count and checksum of all ids."""
    w = Window.orderBy("shard")
    per = shards.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    offs = per.select("shard", (F.sum("_n").over(w) - F.col("_n")).alias("_shard_start"))
    inner = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    place = (shards.select("shard", "seq", "n_ids")
             .withColumn("_in", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
             .join(offs, "shard").select("shard", "seq", (F.col("_in") + F.col("_shard_start")).alias("_start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = decode_blocks(r["payload"]).astype("<u4")
                lens = np.array(r["doc_lengths"], np.int64)
                ends = np.cumsum(lens)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                m = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * m, pa.int32()), pa.array([r["seq"]] * m, pa.int32()),
                     pa.array(r["doc_ids"], pa.int64()), pa.array(ends - lens), pa.array(lens),
                     pa.array(crc, pa.int64())],
                    ["shard", "seq", "doc_id", "_at", "n_tokens", "ids_crc32"])

    docs = shards.select("shard", "seq", "doc_ids", "doc_lengths", "payload").mapInArrow(
        run, "shard int, seq int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return docs.join(place, ["shard", "seq"]).select(
        "doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")
