"""Tests of stored contracts, compaction, retention, registry, running totals, key index and moments."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import lineage as L
from quarry.operators import restate as R
from quarry.operators.windows import sliding_totals
from quarry.quality.key_index import KeyIndex
from quarry.sinks import tables as TB
from quarry.sinks import writers as W

ODD = [(1, "01"), (2, "02"), (3, None), (4, "it's a=b/c%"), (5, "1")]


def rows(spark, path):
    return sorted(map(tuple, TB.read_stored(spark, path, ["p"]).select("k", "p").collect()), key=repr)


@pytest.mark.parametrize("contract", [True, False])
def test_rewrites_keep_odd_partitions(spark, tmpdir_path, contract):
    path, df = f"{tmpdir_path}/t", spark.createDataFrame(ODD, "k int, p string")
    W.append(df, path, ["p"]) if contract else df.write.partitionBy("p").parquet(path)
    W.compact(spark, path, ["p"])
    assert rows(spark, path) == sorted(ODD, key=repr)
    W.merge_or_create(spark, spark.createDataFrame([(3, "03"), (1, None), (9, "01")], "k int, p string"), path, ["k"], ["p"])
    assert rows(spark, path) == sorted([(1, None), (2, "02"), (3, "03"), (4, "it's a=b/c%"), (5, "1"), (9, "01")], key=repr)


def test_a_write_of_another_type_raises(spark, tmpdir_path):
    W.append(spark.createDataFrame(ODD, "k int, p string"), f"{tmpdir_path}/t", ["p"])
    with pytest.raises(TB.ContractError):
        W.append(spark.createDataFrame([(1, 1)], "k int, p int"), f"{tmpdir_path}/t", ["p"])
    with pytest.raises(TB.ContractError):
        W.append(spark.createDataFrame(ODD, "k int, p string"), f"{tmpdir_path}/t", ["k"])


def test_compaction_ends_from_its_journal(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/t"
    for k in range(4):
        W.append(spark.createDataFrame([(k, "x'y"), (k + 10, None)], "k int, p string").coalesce(1), path, ["p"])
    want = rows(spark, path)
    finish = TB.finish_compaction
    monkeypatch.setattr(TB, "finish_compaction", lambda *a: None)  # the driver dies with the journal written
    assert TB.compact_files(spark, path, ["p"], target=1 << 20) == 8
    finish(spark, path)
    finish(spark, path)
    assert rows(spark, path) == want
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs) == 2


def test_markers_under_another_time_zone(spark, tmpdir_path, monkeypatch):
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        path = f"{tmpdir_path}/tracker"
        slot = spark.createDataFrame([("t", "s")], "table string, partition string")
        W.mark_done(spark, path, "j", "t", "s", 1)
        assert R.clear_markers(spark, path, slot) == 1
        assert W.latest_marks(W.read_tracker(spark, path)).first()["status"] == "cleared"
        W.mark_done(spark, path, "j", "t", "s", 2)
        assert W.latest_marks(W.read_tracker(spark, path)).first()["status"] == "success"
    finally:
        monkeypatch.undo()
        time.tzset()


def test_sliding_totals_equal_a_plain_sum(spark):
    at = [0, 1, 2, 7, 7200, 7201, 90000, 172799, 172800]
    bins = spark.createDataFrame([(k, n + 1) for n, k in enumerate(at)], "s long, v long").withColumn("b", F.timestamp_seconds("s"))
    got = {(r["span"], int(r["window_start"].timestamp())): r["v"] for r in sliding_totals(bins, "b", "v", {"a": 5, "b": 3600}, 1).collect()}
    want = {}
    for name, span in (("a", 5), ("b", 3600)):
        for n, k in enumerate(at):
            for start in range(k - span + 1, k + 1):
                want[name, start] = want.get((name, start), 0) + n + 1
    assert got == want


def test_key_index_counts_as_a_full_scan(spark, tmpdir_path):
    index, every = KeyIndex(spark, f"{tmpdir_path}/i", ["a", "b"], buckets=4, bits=16), []
    for slot in range(3):
        part = [(k % 50 if k % 7 else None, str(k % 3)) for k in range(slot * 30, slot * 30 + 60)]
        index.add(spark.createDataFrame(part, "a int, b string"), str(slot))
        every += part
        r = index.uniqueness().first()
        assert (r["rows"], r["distinct_keys"]) == (len(every), len(set(every)))
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame(every, "a int, b string"), "1")


def test_pointer_jumping_on_chains_and_rings(spark):
    edges = [(f"n{k}", f"n{k + 1}") for k in range(300)] + [("n300", "n0"), ("n5", "n200"), ("r1", "r2"), ("r2", "r1"), ("r2", "t")]
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {r["name"]: r["depth"] for r in L.reach(e, "n3").collect()}
    want, level, todo = {}, 0, {"n3"}
    while todo:
        todo = {b for a, b in edges if a in todo} - set(want) - {"n3"}
        level += 1
        want |= {n: level for n in todo}
    assert got == want
    assert {r["name"] for r in L.reach(e, "r1").collect()} == {"r2", "t"}
    levels = {r["task"]: r["level"] for r in L.task_levels(spark.createDataFrame(edges[:300] + edges[301:], "src string, dst string")).collect()}
    assert levels["n300"] == 300 and levels["n200"] == 200 and levels["r1"] == levels["r2"] == levels["t"] == 0
