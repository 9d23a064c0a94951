"""R6, R7 without a rescan of history: a bucketed index of the keys seen, with a Bloom filter in front.

A new slot is reduced to its distinct keys.  The filter (bitmaps of hashed positions, by Spark's bitmap functions)
passes those that history may hold; only they are joined with the index, and only with the buckets they fall in.  The
slot's figures are appended, so the table's row and distinct counts are sums of one small row per slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sinks import tables, writers

SLOTS = "slot string, rows long, slot_keys long, new_keys long, maybe_keys long"


class KeyIndex:
    """Uniqueness of ``keys`` over the slots added so far; ``path`` holds the index.

    ``bits`` is the log2 of the filter's size: about 10 bits a key keep false positives, which cost a lookup and no
    error, near 1 in 100 with ``hashes`` 4.  NULL keys are values, as in R6.
    """

    def __init__(self, spark: SparkSession, path: str, keys, buckets: int = 64, bits: int = 24, hashes: int = 4) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), [keys] if isinstance(keys, str) else list(keys)
        self.buckets, self.bits, self.hashes = buckets, bits, hashes

    def slots(self) -> DataFrame:
        """One row per slot: rows, distinct keys, and how many of them no earlier slot had."""
        place = f"{self.path}/slots"
        return self.spark.read.schema(SLOTS).parquet(place) if writers.path_exists(self.spark, place) else self.spark.createDataFrame([], SLOTS)

    def _place(self, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *self.keys), F.lit(1 << self.bits)) + 1

    def _maybe(self, found: DataFrame) -> DataFrame:
        """The keys that the filter can't rule out."""
        stored = self.spark.read.parquet(f"{self.path}/filter").groupBy("word").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        at = found.select(*self.keys, F.explode(F.array(*[self._place(s) for s in range(self.hashes)])).alias("p"))
        at = at.select(*self.keys, F.bitmap_bucket_number("p").alias("word"), F.bitmap_bit_position("p").alias("bit"))
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # a shift by a column: the power of two of the bit's place in its byte
        mask = F.pow(F.lit(2), F.col("bit") % 8).cast("int")
        hit = at.join(stored, "word").filter(byte.bitwiseAND(mask) > 0)
        return hit.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") == self.hashes).select(*self.keys)

    def add(self, df: DataFrame, slot: str) -> dict:
        """Takes a slot's rows in; returns its figures.  A slot is added once."""
        if not self.slots().filter(F.col("slot") == slot).isEmpty():
            raise ValueError(f"slot {slot} is in the index")
        first = not writers.path_exists(self.spark, f"{self.path}/keys")
        counts = cut_lineage(df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        if first:
            new, maybe = counts, 0
        else:
            probe = cut_lineage(self._maybe(counts).withColumn("_bucket", bucket))
            maybe = probe.count()
            index = tables.read_stored(self.spark, f"{self.path}/keys", ["_bucket"])
            # the index is read in the probe's buckets only (dynamic partition pruning)
            held = tables.keep_where(index, probe, ["_bucket", *self.keys]).select(*self.keys)
            new = cut_lineage(tables.keep_where(counts, held, self.keys, "left_anti"))
        figures = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys")).first()
        row = {"slot": slot, "rows": figures["rows"], "slot_keys": figures["keys"], "new_keys": new.count(), "maybe_keys": maybe}
        writers.append(new.select(*self.keys, bucket.alias("_bucket"), F.lit(slot).alias("slot")), f"{self.path}/keys", ["_bucket"])
        bits = new.select(F.explode(F.array(*[self._place(s) for s in range(self.hashes)])).alias("p"))
        bits.groupBy(F.bitmap_bucket_number("p").alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")) \
            .write.mode("append").parquet(f"{self.path}/filter")
        self.spark.createDataFrame([tuple(row.values())], SLOTS).coalesce(1).write.mode("append").parquet(f"{self.path}/slots")
        return row

    def uniqueness(self) -> DataFrame:
        """One row for the table: rows, distinct keys, duplicates (R6) and the ratio of R7."""
        return self.slots().agg(F.sum("rows").alias("rows"), F.sum("new_keys").alias("distinct_keys"),
                                (F.sum("rows") - F.sum("new_keys")).alias("duplicates"),
                                (F.sum("new_keys") / F.sum("rows")).alias("uniqueness"))
