"""Operators 11 to 13 against brute force, on the driver's tables and on edge rows."""

import hashlib
import math
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import op11_stream_dedup as op11
from quarry.llm import op12_prefix_trie as op12
from quarry.llm import op13_simplex_clusters as op13

from .conftest import LOWER, SF, edge_rows, pairs_of, rows_of

KEPT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def folder(frame):
    """The frame as a Parquet folder: streams read files."""
    path = tempfile.mkdtemp(prefix="llm-stream-") + "/rows"
    frame.write.parquet(path)
    return path


def equal_groups(pairs):
    """Rows without ``kept`` of rows that share id and text: which of those stays is free."""
    groups = {}
    for k, t in pairs:
        groups.setdefault((t or "").translate(LOWER), []).append(k)
    out = []
    for t, ids in groups.items():
        best = max((k for k in ids if k is not None), default=None)
        for n, k in enumerate(sorted(ids, key=lambda k: (k is not None, k or 0))):
            out.append((k, best, len(ids), n == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_stream_dedup(spark, docs):
    got = op11.dedup(spark, f"{SF}/documents.parquet")
    assert rows_of(got, *KEPT) == equal_groups(pairs_of(docs))


def test_stream_dedup_edges(spark, edge, null_ids):
    for frame in (edge, null_ids):
        want = equal_groups([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
        assert rows_of(op11.dedup(spark, folder(frame)), *KEPT) == want


def test_stream_dedup_empty(spark, none):
    assert op11.dedup(spark, folder(none)).collect() == []


def test_stream_dedup_colliding_digests(spark, edge):
    """With a digest of four bits nearly all texts collide; the full check keeps the result exact."""
    weak = lambda text: F.substring(op11.sha256_hex(text), 1, 1)
    want = equal_groups([(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()])
    assert rows_of(op11.dedup(spark, folder(edge), digest=weak), *KEPT) == want


def test_stream_dedup_goes_on(spark):
    """State outlives a query: the second run reads new files only and still finds copies in the first."""
    rows = pairs_of(edge_rows())
    path = tempfile.mkdtemp(prefix="llm-stream-") + "/rows"
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    make(rows[:10])
    op = op11.StreamDedup(spark, path, batch_bytes=1).ingest()
    make(rows[10:])
    again = op11.StreamDedup(spark, path, folder=op.folder).ingest()
    assert rows_of(again.decide(), *KEPT) == equal_groups(rows)
    assert again._state("digests").agg(F.sum("n")).first()[0] == len(rows)


def test_stream_dedup_splits_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(op11, "SPAN", 8)
    rows = [(k, "Same Text" if k % 2 else "same text") for k in range(300)] + [(k, f"text {k}") for k in range(300, 330)]
    path = folder(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert rows_of(op11.dedup(spark, path), *KEPT) == equal_groups(rows)


def trie_of(rows):
    """Nodes by plain Python; rows: (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    mark = lambda t: hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()
    for c in convs:
        convs[c].sort(key=lambda t: (t[0] is not None, t[0] or 0, mark(t)))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple((r, x) for _, r, x in convs.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[:len(node)] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in members)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(built[c]) == len(node)))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
                    sum(len(x) == len(node) + 1 for x in below), sum(leaf(x) for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CONV = "conv_id long, turn long, role string, text string"


def test_trie_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = trie_of([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(op12.trie(table), *NODE) == want


def odd_conversations():
    rows = [(c, k, "user" if k % 2 else "bot", f"turn {k if k < 4 else (c + k) % 3}") for c in range(95, 130) for k in range(c % 9)]
    rows += [(200, None, None, None), (200, None, "user", "é😀"), (200, 1, "user", ""), (203, 0, "x", "one"), (203, 0, "x", "one"),
             (None, 0, "user", "no conversation"), (205, 3, "a:b", "c"), (206, 3, "a", "b:c"), (207, 5, "", "only")]
    rows += [(c, k, "u", "same" * (k % 3)) for c in (300, 301, 304, 377) for k in range(40)]  # long, equal for long
    rows += [(304, 41, "u", "other"), (-5, 1, "u", "negative"), (-100, 1, "u", "base"), (-100, 2, "u", "base 2")]
    return rows


@pytest.mark.parametrize("band", [2, 3, 8, 64])
def test_trie_edges(spark, band):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, CONV).withColumns({"key": F.lit("x"), "n": F.lit(1), "depth": F.lit("clash"), "seg": F.lit(2.5)})
    assert rows_of(op12.trie(frame.repartition(3), band=band), *NODE) == trie_of(rows)


def test_trie_of_nothing(spark):
    assert op12.trie(spark.createDataFrame([], CONV)).collect() == []
    alone = op12.trie(spark.createDataFrame([(7, 0, "u", "only")], CONV))  # base absent, own turn skipped: 7 ends at the root
    assert rows_of(alone, *NODE) == trie_of([(7, 0, "u", "only")])


def test_trie_hashes_ids_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op12, "SPAN", 4)
    rows = [(c, 0, "u", "hello") for c in range(0, 9000, 100)]
    assert rows_of(op12.trie(spark.createDataFrame(rows, CONV)), *NODE) == trie_of(rows)


def kmeans(rows, k=8, rounds=10):
    """Plain integer k-means; rows: (vec_id, list)."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(good, key=named)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, c), n) for n, c in enumerate(centres)) for _, v in good]
    for _ in range(rounds):
        of = [n for _, n in assign()]
        for n in range(len(centres)):
            mine = [v for (_, v), m in zip(good, of) if m == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine)]
    last = assign()
    total = {n: sum(d for d, m in last if m == n) for n in range(len(centres))}
    return sorted(((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(good, last)), key=repr)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rows_of(op13.cluster(table), *CLUSTER) == kmeans([tuple(r) for r in table.select("vec_id", "embedding").collect()])


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(k % 5, 0.05, 64).astype(np.float32)]) for k in range(60)]
    rows += [(k, [0.0] * 64) for k in range(60, 90)] + [rows[3], rows[3]]  # ties, repeated rows
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [1.0] * 63 + [None]), (105, [1.0] * 63 + [float("nan")]),
             (106, [float("inf")] + [1.0] * 63), (None, [-0.5] * 64), (107, [-1e-9] * 64), (108, [3000.0] * 64)]
    return rows


def test_clusters_of_odd_vectors(spark):
    rows = odd_vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"v": F.lit("clash"), "cluster": F.lit(5), "apex": F.lit(None).cast("string")})
    assert rows_of(op13.cluster(frame.repartition(4)), *CLUSTER) == kmeans(rows)


def test_few_or_no_vectors(spark):
    for rows in ([(1, [0.25] * 64)], [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-2.0] * 64)], [(1, [1.0])], []):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert rows_of(op13.cluster(frame), *CLUSTER) == (kmeans(rows) if rows and len(rows[0][1]) == 64 else [])


def test_bounds_hold_and_prune():
    """Lower and upper bounds enclose the true distances, the filter keeps every nearest centroid, and drops many others."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (8, 64))
    v = (centres[rng.integers(0, 8, 4000)] + rng.integers(-150, 150, (4000, 64))).astype(np.int64)
    simplex = op13.Simplex(v[:256])
    a, c = simplex.apex(op13.squared(v, simplex.pivots)), simplex.apex(op13.squared(centres, simplex.pivots))
    true = np.sqrt(op13.squared(v, centres).astype(float))
    flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(2)
    low, high = np.sqrt(flat + (a[:, None, -1] - c[None, :, -1]) ** 2), np.sqrt(flat + (a[:, None, -1] + c[None, :, -1]) ** 2)
    assert (low <= true * (1 + 1e-9) + 1e-3).all() and (high >= true * (1 - 1e-9) - 1e-3).all()
    which, distance, compared = op13.nearest(v, a, centres, simplex)
    assert (which == true.argmin(1)).all() and (distance == op13.squared(v, centres).min(1)).all()
    assert compared < 0.5 * true.size
