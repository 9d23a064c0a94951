"""Prefix trie of conversations by truncation peeling.

Every conversation becomes a path of keys: level 0 is the root, level d the 128-bit hash chain over its
first d turns, so equal prefixes have equal keys.  Paths are cut into segments of ``BAND`` levels.
The trie is then peeled from the greatest depth upwards, one segment of levels at a time:

1. rows of a band are the conversations that end in it (equal ones already one row) and one row for each node at
   its last level that survives from the band below, with the totals of what was peeled off;
2. each row is truncated turn by turn to the band's first level, and equal truncations are regrouped:
   the groups are the band's nodes, with members, smallest member and length;
3. each node hands its own figures to itself and its ancestors in the band (children, leaves, saved
   tokens), summed in one more grouping;
4. the band's nodes are written; its top nodes, regrouped by the key of their parent, survive
   into the next band.

So a conversation of N turns costs N / BAND rounds and rows in proportion to N.  Both groupings
combine inside each task first: the root, or a first turn that a third of all conversations
share, costs one row per task.  The ids behind ``ends_sha256`` are joined in blocks of ``SPAN`` ids, and the
blocks of one node are hashed in order by a stream that holds one Arrow batch.  A conversation's chain
is a stream too: its turns are sorted, and a task holds one segment.  Texts never leave the scan: only
their hashes and lengths are shuffled.

Defined results: turns with equal (or null) ``turn`` stand in the order of their hash, so reruns agree; repeated
rows are repeated turns; null role or text is empty; rows with null ``conv_id`` belong to no conversation and are left
out; the base of a negative id is the next lower multiple of 100; a conversation without turns ends at the root; an
empty table has no nodes.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import scratch_path

from .staging import stage

#: levels of a segment
BAND = 64
#: ids in one block of an ``ends_sha256``
SPAN = 4096
#: conversations that share a base, and the number of first turns that may come from it
SHELF, HEADS = 100, 6
ROOT = hashlib.sha256(b"root").digest()[:16]
SEGMENTS = "conv_id long, seg int, last boolean, prev binary, keys array<binary>, lens array<long>"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, part, turn, mark, n_chars, skip): the turns from the base (part 0) and a conversation's own.

    ``skip`` is the number of own turns to leave out, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    own = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"),
        F.length(text).cast("long").alias("n_chars"))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(SHELF))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    is_base = F.pmod("conv_id", F.lit(SHELF)) == 0
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "mark")
    first = own.filter(is_base).withColumn("at", F.row_number().over(order)).filter(F.col("at") < HEADS)
    convs = own.filter(~is_base).select("conv_id").distinct().select(F.col("conv_id").alias("to"), base.alias("conv_id"), heads.alias("n"))
    lent = first.join(convs, "conv_id").filter("at <= n").select(
        F.col("to").alias("conv_id"), F.lit(0).alias("part"), "turn", "mark", "n_chars", F.lit(0).cast("long").alias("skip"))
    return lent.unionByName(own.select("conv_id", F.lit(1).alias("part"), "turn", "mark", "n_chars",
                                       F.when(is_base, 0).otherwise(heads).cast("long").alias("skip")))


def _chain(band: int):
    """A task's sorted turns to segments of its conversations' paths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, own = [], None, 0
        seg, prev, key, keys, lens = 0, None, ROOT, [ROOT], [0]

        def cut(last: bool):
            out.append((conv, seg, last, prev, keys, lens))

        def table():
            cols = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            names = ["conv_id", "seg", "last", "prev", "keys", "lens"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            for c, part, mark, n, skip in zip(*(b.column(k).to_pylist() for k in ("conv_id", "part", "mark", "n_chars", "skip"))):
                if c != conv:
                    if conv is not None:
                        cut(True)
                    conv, own, seg, prev, key, keys, lens = c, 0, 0, None, ROOT, [ROOT], [0]
                if part:
                    own += 1
                    if own <= skip:
                        continue
                if len(keys) == band:
                    cut(False)
                    prev, seg, keys, lens = key, seg + 1, [], []
                key = hashlib.sha256(key + mark).digest()[:16]
                keys.append(key)
                lens.append(n)
            if out:
                yield table()
                out = []
        if conv is not None:
            cut(True)
            yield table()

    return run


def paths(conversations: DataFrame, band: int) -> DataFrame:
    turns = rebuilt(conversations).repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", F.asc_nulls_first("turn"), "mark")
    return turns.select("conv_id", "part", "mark", "n_chars", "skip").mapInArrow(_chain(band), SEGMENTS)


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, block, n, low, ids) to one row per key with the hash of all its ids."""
    key, total, low, digest = None, 0, None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([low]), pa.array([total]), pa.array([digest.hexdigest()])],
                                          ["key", "conv_id", "n", "ends"])

    for b in batches:
        for k, n, first, ids in zip(*(b.column(c).to_pylist() for c in ("key", "n", "low", "ids"))):
            if k != key:
                if key is not None:
                    yield row()
                key, total, low, digest = k, 0, first, hashlib.sha256()
            digest.update(("," if total else "").encode() + ids.encode())
            total += n
    if key is not None:
        yield row()


def ended(segments: DataFrame) -> DataFrame:
    """One row per distinct whole path: its smallest conversation, their number, hash of their ids, last segment."""
    ids = segments.filter("last").select("conv_id", F.element_at("keys", -1).alias("key"))
    blocks = ids.groupBy("key", F.floor(F.col("conv_id") / SPAN).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    text = F.concat_ws(",", F.transform("ids", lambda x: x.cast("string")))
    sums = (blocks.select("key", "block", "n", "low", text.alias("ids")).repartition("key").sortWithinPartitions("key", "block")
            .select("key", "n", "low", "ids").mapInArrow(_hash_blocks, "key binary, conv_id long, n long, ends string"))
    return segments.filter("last").drop("last").join(sums.drop("key"), "conv_id")


NONE = hashlib.sha256().hexdigest()
ZERO = ("children", "leaves", "saved")


def _peel(rows: DataFrame, band: int) -> DataFrame:
    """Nodes of a band from its rows (seg, prev, keys, lens, conv_id, n, ends, children, leaves, saved)."""
    depth = F.col("seg") * band + F.col("i")
    end = F.col("i") == F.size("keys") - 1
    cut = rows.select("*", F.posexplode("keys").alias("i", "key"))
    at_end = [F.sum(F.when(end, F.col(c)).otherwise(0)).alias(c) for c in ZERO]
    nodes = cut.groupBy("key").agg(
        F.min(depth).alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.min("prev").alias("prev"),
        F.max(F.when(end, F.col("ends"))).alias("ends"), F.max((~end).cast("int")).alias("through"),
        F.min(F.get("lens", F.col("i"))).alias("len"), F.first(F.slice("keys", F.lit(1), F.col("i") + 1)).alias("path"), *at_end)
    up = nodes.select("*", F.posexplode("path").alias("i", "to"))
    me, parent = F.col("i") == F.size("path") - 1, F.col("i") == F.size("path") - 2
    leaf = ((F.col("through") == 0) & (F.col("children") == 0)).cast("long")
    mine = lambda c, as_=None: F.max(F.when(me, F.col(c))).alias(as_ or c)
    return up.groupBy(F.col("to").alias("key")).agg(
        mine("depth"), mine("conv_id"), mine("n", "n_convs"), mine("prev"), mine("ends"), mine("path"),
        F.sum(F.when(me, F.col("children")).when(parent, 1).otherwise(0)).alias("n_children"),
        F.sum(F.col("leaves") + leaf).alias("n_leaves"),
        F.sum(F.col("saved") + (F.col("n") - 1) * F.col("len")).alias("saved_tokens")).select(
        "key", F.coalesce(F.get("path", F.size("path") - 2), "prev").alias("parent"), "depth", "conv_id",
        *(F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))


def trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node, with the columns of the contract, ``key`` and ``parent``."""
    spark: SparkSession = conversations.sparkSession
    segments = stage(paths(conversations, band), "trie-paths")
    ends = stage(ended(segments), "trie-ends")
    top = segments.agg(F.max("seg")).first()[0]
    folder, carried, schema = scratch_path(spark, "trie-nodes"), None, None
    for seg in range(top if top is not None else -1, -1, -1):
        rows = ends.filter(F.col("seg") == seg).select("*", *(F.lit(0).cast("long").alias(c) for c in ZERO))
        if carried is not None:
            whole = segments.filter((F.col("seg") == seg) & ~F.col("last")).drop("last")
            rows = rows.unionByName(whole.join(carried, "conv_id"))
        at = f"{folder}/seg={seg}"
        _peel(rows, band).write.parquet(at)
        nodes = spark.read.parquet(at)
        schema = nodes.schema
        if seg:
            carried = nodes.filter(F.col("depth") == seg * band).groupBy("parent").agg(
                F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.lit(None).cast("string").alias("ends"),
                F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).drop("parent")
    if schema is None:
        return _named(_peel(ends.select("*", *(F.lit(0).cast("long").alias(c) for c in ZERO)), band))
    return _named(spark.read.schema(schema).parquet(f"{folder}/seg=*"))


def _named(nodes: DataFrame) -> DataFrame:
    """Adds each parent's ``conv_id``.  One row stands on the parents' side of a key, so a parent with many
    children costs no memory, and Spark may split its children over tasks."""
    above = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256", "key", "parent")
