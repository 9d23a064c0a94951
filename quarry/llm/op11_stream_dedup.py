"""Exact dedup as a stateful stream.

``ingest`` runs a Structured Streaming query over the files of a table.  Its state is keyed by the
SHA-256 digest of the normalised text (A-Z lower-cased) and lies in RocksDB, on disk, under the
query's checkpoint.  There is no watermark, so no key ever expires.  A key's state is

* ``keep``: the stable identifier (the largest ``doc_id`` seen) and the content locator of its row
  (file and row in the file), and
* ``n``: the rows seen.

The next ``ingest`` with the same folder reads only new files and goes on from the kept state.  The
aggregate combines rows inside each task before the shuffle, so a digest that a third of all rows
share costs one row per task.

``decide`` reads the state back as a table and checks every hit: a row whose digest has more than
one row is compared, byte for byte, with the text found at the locator.  Rows of a digest whose texts
differ (a collision) go through a second stream whose key also holds the whole normalised text, so the
result is exact for any digest.  The compared rows of a group are dealt over ``ceil(n / SPAN)`` salts, and the
text at the locator is copied once to each salt, so no task holds a group.

Defined results: a null text counts as empty; a null ``doc_id`` is smaller than any other; of rows
equal in text and id the one with the largest (file, row) stays; an empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import scratch_path

from . import textnp as tn
from .staging import stage

#: rows of a group compared under one salt
SPAN = 1024
#: bytes of input files in one micro-batch
BATCH_BYTES = 256 << 20
#: the state's store: on disk, a batch uploads its changes only, and small partitions reserve no disk ahead
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with A-Z lower-cased."""
    buf, offs = tn.flat(text)
    return LOWER[buf], offs


@F.arrow_udf(T.StringType())
def sha256_hex(text: pa.Array) -> pa.Array:
    """SHA-256 of the normalised text, lowercase hex."""
    buf, offs = lowered(text)
    view, at = memoryview(np.ascontiguousarray(buf)), offs.tolist()
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())


def _normal(text: F.Column) -> F.Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _glob(path: str) -> str:
    """``path`` as a pattern that matches itself alone: a file source takes a single file only so."""
    return f"{path[:-1]}[{path[-1]}]" if not any(c in path for c in "*?[{") else path


def _rows(frame: DataFrame, id_col: str, text_col: str, digest: Callable) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return frame.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"),
                        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


class StreamDedup:
    """Exact dedup of a growing folder of Parquet files; ``folder`` holds the streams' state.

    ``digest`` maps a text column to a string column; another one than SHA-256 of the normalised text
    must still be equal for texts that are equal after normalising.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", digest: Callable = sha256_hex, batch_bytes: int = BATCH_BYTES) -> None:
        self.spark, self.path, self.digest = spark, path.rstrip("/"), digest
        self.folder = (folder or scratch_path(spark, "stream-dedup")).rstrip("/")
        self.names, self.batch_bytes = (id_col, text_col), batch_bytes
        self.schema = spark.read.parquet(self.path).select(id_col, text_col).schema

    def _state(self, lane: str) -> DataFrame:
        """The newest committed state: the key columns, ``keep`` and ``n``."""
        held = self.spark.read.format("statestore").load(f"{self.folder}/{lane}")
        return held.select("key.*", "value.*").toDF(*held.schema["key"].dataType.names, "keep", "n")

    def _stream(self, lane: str, key: list[str], keep: Callable[[DataFrame], DataFrame]) -> None:
        """Feeds all files not yet seen to the state of ``lane``; exactly once, by its checkpoint."""
        files = (self.spark.readStream.schema(self.schema).option("maxBytesPerTrigger", str(self.batch_bytes))
                 .parquet(_glob(self.path)))
        rows = keep(_rows(files, *self.names, self.digest))
        state = rows.groupBy(*key).agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        before = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            query = (state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                     .option("checkpointLocation", f"{self.folder}/{lane}").start())
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        query.awaitTermination()

    def ingest(self) -> StreamDedup:
        """Takes the rows of all files that came since the last call into the state."""
        self._stream("digests", ["digest"], lambda rows: rows.drop("text"))
        return self

    def decide(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of every ingested row, hits checked in full."""
        here = F.struct("doc_id", "file", "row")
        docs = _rows(self.spark.read.schema(self.schema).parquet(self.path), *self.names, self.digest)
        met = stage(docs.join(self._state("digests"), "digest").select(
            "doc_id", "file", "row", "digest", "keep", "n", F.when(F.col("n") > 1, F.col("text")).alias("text"),
            sha256_hex("text").alias("sha") if self.digest is not sha256_hex else F.col("digest").alias("sha")), "dedup-met")
        salts = F.ceil(F.col("n") / SPAN)
        hits = met.filter("n > 1")
        heads = hits.filter(here == F.col("keep")).select(
            "digest", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("text").alias("head"))
        rows = hits.filter(here != F.col("keep")).select(
            "digest", F.pmod(F.xxhash64("file", "row"), salts).alias("salt"), "text")
        same = (F.col("text") == F.col("head")) | (_normal(F.col("text")) == _normal(F.col("head")))
        clash = stage(rows.join(heads, ["digest", "salt"], "left").filter(~F.coalesce(same, F.lit(False)))
                      .select("digest").distinct(), "dedup-clash")
        alone = met.drop("text")
        if clash.limit(1).count():
            part = lambda rows: rows.join(clash, "digest", "left_semi").withColumn("text", _normal(F.col("text")))
            lane = f"texts-{scratch_path(self.spark, 'x')[-12:]}"
            self._stream(lane, ["digest", "text"], part)
            exact = part(docs).join(self._state(lane), ["digest", "text"]).select(
                "doc_id", "file", "row", "digest", "keep", "n", sha256_hex("text").alias("sha"))
            alone = alone.join(clash, "digest", "left_anti").unionByName(exact)
        return alone.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                            (here == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(spark: SparkSession, path: str, **options) -> DataFrame:
    """One run over the table at ``path``: ingest all its files, then decide."""
    return StreamDedup(spark, path, **options).ingest().decide()
