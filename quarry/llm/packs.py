"""Documents in packed blocks, and counts exchanged between blocks and key buckets.

``pack`` stores documents as rows of about ``BLOCK_BYTES`` of text, compressed, in the shared
folder.  Several operators need, for every n-gram of every block, a figure over the whole
corpus.  They ask and answer in bulk:

* ``ask``: a block sends its distinct keys, cut into buckets by their top bits, one binary row
  per bucket (``bucket``, ``block``, ``part``, ``payload``);
* ``answer``: a bucket sees the keys of all blocks, and replies to each with an array that
  lines up with the keys it sent;
* ``join_replies``: block and replies meet again.

A hot key costs one entry per block, whatever its count, so buckets stay even.

The exchange has a row for each block and bucket.  So that its rows grow with the text and not with its square, blocks and
buckets both grow with the square root of the text (``sizes``): a row then stands for about ``ROW_BYTES`` of text.  Both are held in
one task's memory, so they stop at ``MAX_BLOCK_BYTES`` and ``MAX_BUCKET_BYTES``; beyond ``MAX_BLOCK_BYTES * MAX_BUCKET_BYTES /
ROW_BYTES`` of text (256 GB) rows get shorter and their number grows faster than the text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .staging import stage

BLOCK_BYTES, MAX_BLOCK_BYTES = 4 << 20, 32 << 20
BLOCK_ROWS = 1 << 18
BUCKET_BYTES, MAX_BUCKET_BYTES = 8 << 20, 128 << 20
ROW_BYTES = 16 << 10


def sizes(total: int) -> tuple[int, int]:
    """Bytes of text of a block and of a bucket for ``total`` bytes."""
    block = int(min(MAX_BLOCK_BYTES, max(BLOCK_BYTES, np.sqrt(total * ROW_BYTES * BLOCK_BYTES / BUCKET_BYTES))))
    return block, int(min(MAX_BUCKET_BYTES, max(BUCKET_BYTES, total * ROW_BYTES / block)))


def squeeze(raw: bytes | np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw if isinstance(raw, bytes) else raw.tobytes())


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def seal(batch: pa.RecordBatch, level: int = 3) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unseal(payload: bytes) -> pa.RecordBatch:
    """Columns ``rid`` (a key unique to the row), ``doc_id`` and ``text``."""
    with pa.ipc.open_stream(payload) as r:
        return r.read_next_batch()


def pack(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text",
         part_of: Callable[[pa.Array], np.ndarray] | None = None, level: int = 3,
         as_kept: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Staged blocks: ``block``, ``part``, ``n_bytes``, ``payload``.  Rows are kept as they are, or as ``as_kept``
    makes of a block's rows.

    ``part_of`` deals rows by their ids into parts; a block holds rows of one part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    block_bytes, _ = sizes(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 40, 0
        held: dict[int, list] = {}

        def flush(part: int):
            nonlocal seq
            batches, size, _ = held.pop(part)
            ids = pa.concat_arrays([h.column(0) for h in batches])
            text = pa.concat_arrays([h.column(1) for h in batches])
            rid = pa.array(base + (seq << 20) + np.arange(len(ids), dtype=np.int64))
            rows = pa.RecordBatch.from_arrays([rid, ids, text], ["rid", "doc_id", "text"])
            body = seal(rows if as_kept is None else as_kept(rows), level)
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([base + (seq - 1 << 20)], pa.int64()), pa.array([part], pa.int32()),
                 pa.array([size], pa.int64()), pa.array([body], pa.binary())], ["block", "part", "n_bytes", "payload"])

        for b in batches:
            for lo, hi in tn.chunks(b.column(1)):
                for at in range(lo, hi, BLOCK_ROWS):
                    piece = b.slice(at, min(hi, at + BLOCK_ROWS) - at)
                    piece = pa.RecordBatch.from_arrays(
                        [piece.column(0).cast(pa.int64()), piece.column(1).cast(pa.string())], ["doc_id", "text"])
                    of = np.zeros(len(piece), np.int64) if part_of is None else part_of(piece.column(0))
                    for part in np.unique(of).tolist():
                        sub = piece if part_of is None else piece.filter(pa.array(of == part))
                        got = held.setdefault(part, [[], 0, 0])
                        got[0].append(sub)
                        got[1] += len(tn.flat(sub.column(1))[0])
                        got[2] += len(sub)
                        if got[1] >= block_bytes or got[2] >= BLOCK_ROWS:
                            yield flush(part)
        for part in list(held):
            yield flush(part)

    return stage(rows.mapInArrow(run, "block long, part int, n_bytes long, payload binary"), name)


def bucket_bits(packs: DataFrame) -> int:
    """log2 of the number of buckets for the text in ``packs``."""
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    return max(5, int(np.ceil(np.log2(max(1, total / sizes(total)[1])))))


def ask(packs: DataFrame, bits: int, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, Callable[[int, int], bytes]]]) -> DataFrame:
    """Rows (bucket, block, part, payload).  ``keys_of`` gives a block's sorted keys and a function
    that writes the payload of a range of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, part, payload in zip(*(c.to_pylist() for c in b.columns)):
                keys, write = keys_of(unseal(payload))
                cut = bucket_cuts(keys, bits)
                got = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got, pa.int32()), pa.array([block] * len(got), pa.int64()),
                     pa.array([part] * len(got), pa.int32()),
                     pa.array([write(cut[k], cut[k + 1]) for k in got.tolist()], pa.binary())],
                    ["bucket", "block", "part", "payload"])

    return packs.select("block", "part", "payload").mapInArrow(run, "bucket int, block long, part int, payload binary")


def bucket_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys (and the end)."""
    edge = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


def answer(asked: DataFrame, reply: Callable[[list[bytes], list[int]], list[bytes]]) -> DataFrame:
    """Rows (block, bucket, reply): one reply for each payload a bucket was sent."""
    def run(t: pa.Table) -> pa.Table:
        out = reply(t.column("payload").to_pylist(), t.column("block").to_pylist())
        return pa.table([t.column("block"), t.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "reply"])

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, reply binary")


def join_replies(packs: DataFrame, replies: DataFrame, fn: Callable[[pa.RecordBatch, list[bytes]], Iterator[pa.RecordBatch]],
                 schema: str) -> DataFrame:
    """``fn`` of each block's documents and its replies in bucket order."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.sort_by("bucket").column("reply").to_pylist()
        out = [x for payload in left.column("payload").to_pylist() for x in fn(unseal(payload), order)]
        return pa.Table.from_batches(out) if out else None

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        got = run(left, right) if left.num_rows else None
        return arrow.empty_table() if got is None else got.cast(arrow)

    return (packs.select("block", "payload").groupBy("block")
            .cogroup(replies.groupBy("block")).applyInArrow(whole, schema))


def put_u32(x: np.ndarray) -> bytes:
    """Sorted u32 values: differences, byte planes, zstd."""
    d = np.diff(x, prepend=x[:1] * 0).astype("<u4")
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T))


def get_u32(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)


def put_u64(x: np.ndarray) -> bytes:
    """Sorted u64 values: differences, byte planes, zstd."""
    d = np.diff(x, prepend=x[:1] * 0).astype("<u8")
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def get_u64(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def put_counts(x: np.ndarray) -> bytes:
    """Non-negative counts: byte planes, zstd."""
    return squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def get_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def frames(*parts: bytes) -> bytes:
    """Several byte strings as one."""
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unframe(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 4], "little")
        out.append(raw[at + 4:at + 4 + n])
        at += 4 + n
    return out
