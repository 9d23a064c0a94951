"""Stored table contracts, NULL-safe partitions, bin-packing compaction and version retention.

Spark guesses the type of a partition column from its folder names, so a string column that
holds "01" reads back as the number 1 and a rewrite would write a second folder ``p=1`` beside ``p=01``.  A
table's contract (its schema, partition types included, and its partition columns) is therefore
stored beside it as ``{path}_contract/contract.json`` when it is first written, and every
operator that rewrites a table reads it by that contract.  A folder without one is read with its partition
columns as strings, which keeps every folder name as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: the folder name of a NULL partition
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file whole: written beside it, then renamed."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(tmp)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"{path} was not written")


def _place(path: str) -> str:
    return f"{path.rstrip('/')}_contract/contract.json"


def load_contract(spark: SparkSession, path: str) -> tuple[T.StructType, list[str]] | None:
    """(schema, partition columns) of the table at ``path``, or None."""
    text = read_text(spark, _place(path))
    if text is None:
        return None
    found = json.loads(text)
    return T.StructType.fromJson(found["schema"]), found["partition_cols"]


class ContractError(ValueError):
    pass


def keep_contract(df: DataFrame, path: str, partition_cols) -> None:
    """Stores the contract on the first write; later writes must keep the partition columns and
    every column's type.  New data columns are added to it."""
    parts, spark = list(partition_cols), df.sparkSession
    have = load_contract(spark, path)
    plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    if have is not None:
        schema, held = have
        if parts != held:
            raise ContractError(f"{path} is partitioned by {held}, not by {parts}")
        types = {f.name: f.dataType for f in schema}
        bad = [f"{f.name}: {types[f.name].simpleString()}, not {f.dataType.simpleString()}"
               for f in plain if f.name in types and types[f.name] != f.dataType]
        if bad:
            raise ContractError(f"{path} holds {'; '.join(bad)}")
        new = [f for f in plain if f.name not in types]
        if not new:
            return
        plain = T.StructType(schema.fields + new)
    write_text(spark, _place(path), json.dumps({"schema": plain.jsonValue(), "partition_cols": parts}))


def read_stored(spark: SparkSession, path: str, partition_cols=()) -> DataFrame:
    """The table with the types it was written with (see the module's text)."""
    have = load_contract(spark, path)
    if have is not None:
        return spark.read.schema(have[0]).parquet(path)
    guessed = spark.read.parquet(path).schema
    parts = set(partition_cols)
    return spark.read.schema(T.StructType([
        T.StructField(f.name, T.StringType() if f.name in parts else f.dataType, True) for f in guessed])).parquet(path)


def same(left: DataFrame, right: DataFrame, cols: Iterable[str], prefix: str = "__r_") -> tuple[DataFrame, Column]:
    """``right`` with its ``cols`` renamed, and the NULL-safe condition that joins it to ``left``."""
    cols = list(cols)
    renamed = right.select(*[F.col(f"`{c}`").alias(prefix + c) if c in cols else F.col(f"`{c}`") for c in right.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[f"`{c}`"].eqNullSafe(renamed[f"`{prefix}{c}`"])
    return renamed, cond


def keep_where(left: DataFrame, right: DataFrame, cols, how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` with (``left_semi``) or without (``left_anti``) a row of ``right`` equal in ``cols``;
    NULLs are equal."""
    renamed, cond = same(left, right.select(*cols), cols)
    return left.join(renamed, cond, how)


def partition_folder(cols, values) -> str:
    """``a=1/b=x`` with Hive's escapes, from values that Spark cast to string (None: the NULL folder)."""
    special = set('"#%\'*/:=?\\\x7f{[]^') | {chr(i) for i in range(1, 32)}
    esc = lambda s: "".join(f"%{ord(c):02X}" if c in special else c for c in s)
    return "/".join(f"{esc(c)}={NULL_PARTITION if v in (None, '') else esc(v)}" for c, v in zip(cols, values))


def drop_partitions(spark: SparkSession, path: str, parts: list[str], gone: DataFrame) -> None:
    """Deletes the folders of the partitions in ``gone`` (one row per partition)."""
    for row in gone.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in parts]).toLocalIterator():
        fs, folder = _fs(spark, f"{path.rstrip('/')}/{partition_folder(parts, row)}")
        fs.delete(folder, True)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def partition_spec(cols, values) -> str:
    """``PARTITION (a = '1', b = NULL)`` from values that Spark cast to string."""
    return "PARTITION (" + ", ".join(f"`{c.replace('`', '``')}` = {'NULL' if v is None else sql_text(v)}" for c, v in zip(cols, values)) + ")"


def table_ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, folder, length, modified) of the data files below ``path``, from the file system's listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
                        F.col("length"), F.col("modificationTime").alias("modified"))


def plan_bins(files: DataFrame, target: int) -> DataFrame:
    """K13's plan: (file, folder, length, bin) of the files to merge.

    Files of ``target`` bytes or more are left alone.  The others of a folder, largest first, are
    cut where their running total passes a multiple of ``target``, so a bin holds less than twice
    that; a bin with one file is left alone too.
    """
    w = Window.partitionBy("folder").orderBy(F.desc("length"), "file")
    small = files.filter(F.col("length") < target)
    cut = small.withColumn("bin", F.floor((F.sum("length").over(w) - F.col("length")) / F.lit(target)))
    return cut.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("folder", "bin"))).filter("__n > 1").drop("__n")


def compact_files(spark: SparkSession, path: str, partition_cols=(), target: int = 128 << 20, where=None) -> int:
    """Merges the small files of each partition into files of about ``target`` bytes.

    Files of the target size or more keep their names and are not read.  The merged files are written beside the
    table first; then a journal names the files they replace; then those are deleted and
    the new ones moved in.  ``finish_compaction`` carries out a journal that a lost driver left behind, so rows
    are never lost or doubled for good.  ``where`` chooses partitions.  Returns the files replaced.
    """
    from ..session import cut_lineage

    finish_compaction(spark, path)
    parts, base = list(partition_cols), path.rstrip("/")
    # the size condition prunes the large files when the scan is planned
    df = read_stored(spark, base, parts).filter(F.col("_metadata.file_size") < target)
    if where is not None:
        df = df.filter(where)
    file = F.col("_metadata.file_path")
    files = df.select(file.alias("file"), F.col("_metadata.file_size").alias("length")).distinct()
    plan = cut_lineage(plan_bins(files.withColumn("folder", F.regexp_replace("file", "/[^/]*$", "")), target))
    n = plan.count()
    if not n:
        return 0
    work = f"{base}_compact/{uuid.uuid4().hex[:12]}"
    bins = plan.select(F.col("file").alias("__file"), F.col("folder").alias("__folder"), F.col("bin").alias("__bin"))
    merged = df.withColumn("__file", file).join(bins, "__file").repartition("__folder", "__bin") \
        .sortWithinPartitions("__folder", "__bin").drop("__file", "__folder", "__bin")
    w = merged.write.mode("overwrite")
    (w.partitionBy(*parts) if parts else w).parquet(f"{work}/new")
    plan.select("file").coalesce(1).write.mode("overwrite").text(f"{work}/old")
    write_text(spark, f"{work}/ready", "1")
    finish_compaction(spark, path)
    return n


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Carries out the journals of compactions whose merged files are complete; drops the others."""
    base = path.rstrip("/")
    fs, home = _fs(spark, f"{base}_compact")
    if not fs.exists(home):
        return
    for job in fs.listStatus(home):
        work = job.getPath().toString()
        if read_text(spark, f"{work}/ready") is not None:
            # files are deleted first: a repeated run finds them gone, and moves what is not moved yet
            for row in spark.read.text(f"{work}/old").toLocalIterator():
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row[0])), False)
            new = fs.makeQualified(_fs(spark, f"{work}/new")[1]).toString()
            left = list_files(spark, new).select("file").toLocalIterator() if fs.exists(_fs(spark, new)[1]) else ()
            for row in left:
                at = row[0][row[0].index("/new/") + 5:]
                _, to = _fs(spark, f"{base}/{at}")
                fs.mkdirs(to.getParent())
                if not fs.rename(_fs(spark, row[0])[1], to):
                    raise OSError(f"{row[0]} was not moved to {to}")
        fs.delete(job.getPath(), True)


def version_window(versions: DataFrame, keep: int, as_of, support_days: int = 0, in_use: DataFrame | None = None) -> DataFrame:
    """K15 over ``version=vN`` folders: every version with whether it may go.

    ``versions`` has ``version`` and ``published_at``.  A version goes when ``keep`` newer ones exist, its successor
    was published more than ``support_days`` days before ``as_of``, and ``in_use`` (``version``) does not name it.
    Rows: version, published_at, superseded_at, rank (1 is the newest), in_use, retire.
    """
    number = F.regexp_extract(F.col("version").cast("string"), r"(\d+)$", 1).cast("long")
    order = Window.orderBy(F.col("__n").desc())  # one row per version of one asset
    out = versions.withColumn("__n", number).withColumn("rank", F.row_number().over(order)) \
        .withColumn("superseded_at", F.lag("published_at").over(order))
    used = F.lit(False)
    if in_use is not None:
        marks = in_use.select(F.col("version").alias("__v")).distinct().withColumn("__used", F.lit(True))
        out = out.join(marks, F.col("version").eqNullSafe(F.col("__v")), "left").drop("__v")
        used = F.coalesce("__used", F.lit(False))
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(support_days)} DAYS")
    old = F.coalesce(F.col("superseded_at").cast("timestamp") < limit, F.lit(False))
    return out.select("version", "published_at", "superseded_at", "rank", used.alias("in_use"),
                      ((F.col("rank") > keep) & old & ~used).alias("retire"))


def stored_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, published_at, files, bytes) of the ``version=vN`` folders below ``path``; a version is published when its
    last file is there."""
    return list_files(spark, path).withColumn("version", F.regexp_extract("folder", r"/version=([^/]+)", 1)) \
        .filter("version <> ''").groupBy("version").agg(
            F.max("modified").alias("published_at"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def retire_versions(spark: SparkSession, path: str, keep: int, as_of, support_days: int = 0, in_use: DataFrame | None = None,
                    versions: DataFrame | None = None) -> list[str]:
    """Deletes the version folders that ``version_window`` retires; returns their names.

    ``versions`` (version, published_at) comes from the catalogue, or from the folders themselves."""
    found = version_window(versions if versions is not None else stored_versions(spark, path), keep, as_of, support_days, in_use)
    gone = [r["version"] for r in found.filter("retire").select("version").toLocalIterator()]
    for v in gone:
        fs, p = _fs(spark, f"{path.rstrip('/')}/version={v}")
        fs.delete(p, True)
    return gone
