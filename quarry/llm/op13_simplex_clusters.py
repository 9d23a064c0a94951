"""Centroid clustering with n-simplex projection.

Vectors become integers, floor(1024 * x).  A few pivots are chosen; the exact squared distance of
every vector to every pivot is computed once and cached with the vector.  The pivots span a simplex,
whose corners have coordinates by their mutual distances (a triangular matrix); a vector is the apex of a
simplex over that base, and its cached distances give its coordinates: its place in the base's
space and its height over it.  For two apexes,

* the Euclidean distance with heights of the same side is a lower bound of the true distance,
* with heights of opposite sides it is an upper bound.

In each round a centroid whose lower bound exceeds the smallest upper bound can't be nearest; only the
others are compared exactly, in integers.  The bounds are widened by ``SLACK`` of their scale, far above
the rounding of float64 and of the triangular solve, so the filter never drops the nearest centroid or a tie.

Each round is one pass over the staged vectors: a task returns one row of sums per centroid, and the driver gets
the ``k`` x ``DIMS`` totals (the centroids themselves, whatever the input).  Pivots come from a bounded sample: the
``SAMPLE`` vectors with the smallest hash, taken farthest first; they change the speed, not the result.

Defined results: vectors with another number of components, or with a null, NaN or infinite one, are left out,
and so are those with a component of ``LIMIT`` or more in size, whose squared distances don't fit a long; repeated
rows count as often as they stand; a null ``vec_id`` has no hash and comes last in the order of centroids, equal
hashes are ordered by their components; with fewer than ``k`` vectors there are fewer centroids; no vectors give no
rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

DIMS, K, ROUNDS, SCALE = 64, 8, 10, 1024
#: pivots at most, and the vectors that they are chosen from
PIVOTS, SAMPLE = 10, 256
#: a pivot stands at least this share of the simplex' size above the others' span
HEIGHT = 1e-2
SLACK = 1e-6
LIMIT = 1 << 27
CHUNK = 1 << 14


def quantised(embeddings: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, v): the kept vectors as integers."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE))
    good = lambda e: e.isNotNull() & (F.abs(e.cast("double")) < LIMIT / SCALE)  # noqa: E731  false for NaN and infinities
    return (embeddings.filter((F.size("embedding") == dims) & F.forall("embedding", good))
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<int>").alias("v")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def squared(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``v`` to every point."""
    out = np.empty((len(v), len(points)), np.int64)
    for k, p in enumerate(points):
        d = v.astype(np.int64) - p
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


class Simplex:
    """The base simplex of some pivots; ``apex`` maps squared distances to coordinates."""

    def __init__(self, sample: np.ndarray) -> None:
        """Pivots of ``sample``, farthest first; points close to the span of those before are passed over."""
        self.pivots, rows = sample[:1].astype(np.int64), []
        while len(sample) and len(self.pivots) < PIVOTS:
            self.base = np.array(rows).reshape(len(rows), len(rows))
            far = self.apex(squared(sample, self.pivots))
            k = int(np.argmax(far[:, -1]))
            if far[k, -1] <= HEIGHT * max(1.0, np.sqrt((far ** 2).sum(1).max())):
                break
            rows = [np.append(r, 0.0) for r in rows] + [far[k]]
            self.pivots = np.concatenate([self.pivots, sample[k:k + 1].astype(np.int64)])
        self.base = np.array(rows).reshape(len(rows), len(rows))

    def apex(self, dist: np.ndarray) -> np.ndarray:
        """Coordinates in the base's space and the height, from squared distances to the pivots."""
        d, n = dist.astype(float), len(self.base)
        out = np.zeros((len(d), n + 1))
        for k in range(n):  # pivot k + 1 lies at row k of the triangular base; pivot 0 at the origin
            row = self.base[k]
            right = (d[:, 0] - d[:, k + 1] + (row ** 2).sum()) / 2
            out[:, k] = (right - out[:, :k] @ row[:k]) / row[k]
        out[:, n] = np.sqrt(np.maximum(0.0, d[:, 0] - (out[:, :n] ** 2).sum(1)))
        return out


def candidates(apex: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Mask of the centroids that may be nearest, by the bounds between apexes."""
    flat = ((apex[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(2)
    low = flat + (apex[:, None, -1] - centres[None, :, -1]) ** 2
    high = flat + (apex[:, None, -1] + centres[None, :, -1]) ** 2
    slack = SLACK * (1.0 + (apex ** 2).sum(1) + (centres ** 2).sum(1).max())
    return low <= high.min(1)[:, None] + slack[:, None]


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number on ties), exact squared distance, and the exact comparisons made."""
    maybe = candidates(apex, simplex.apex(squared(centroids, simplex.pivots)))
    best = np.full(len(v), np.iinfo(np.int64).max)
    which = np.zeros(len(v), np.int32)
    for k in range(len(centroids)):
        at = np.flatnonzero(maybe[:, k])
        d = squared(v[at], centroids[k:k + 1])[:, 0]
        closer = d < best[at]
        best[at[closer]], which[at[closer]] = d[closer], k
    return which, best, int(maybe.sum())


def _assigning(centroids: np.ndarray, simplex: Simplex, dims: int, done: Callable, close: Callable = lambda: ()):
    """Runs ``done(ids, vectors, which, distance)`` on chunks of the staged vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), CHUNK):
                part = b.slice(lo, CHUNK)
                v, apex = matrix(part.column("v"), dims), matrix(part.column("apex"), len(simplex.base) + 1)
                yield from done(part.column("vec_id"), v, *nearest(v, apex, centroids, simplex)[:2])
        yield from close()

    return run


def _sums(cached: DataFrame, centroids: np.ndarray, simplex: Simplex, dims: int) -> tuple[np.ndarray, list[list[int]]]:
    """Members and exact component sums of every centroid."""
    k = len(centroids)

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)

        def add(ids, v, which, distance):
            for c in range(k):
                mine = v[which == c]
                n[c] += len(mine)
                total[c] += mine.sum(0, dtype=np.int64)
            return ()

        def end():
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))],
                                             ["cluster", "n", "total"])

        yield from _assigning(centroids, simplex, dims, add, end)(batches)

    rows = (cached.mapInArrow(run, "cluster int, n long, total array<long>").filter("n > 0")
            .select("cluster", "n", F.posexplode("total").alias("i", "x"))
            .groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect())
    n, total = [0] * k, [[0] * dims for _ in range(k)]
    for r in rows:
        n[r["cluster"]], total[r["cluster"]][r["i"]] = r["n"], int(r["x"])
    return n, total


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """One row per kept vector, with the columns of the contract."""
    vectors = quantised(embeddings, dims)
    named = lambda salt: F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    pick = lambda salt, n: np.array([r["v"] for r in vectors.orderBy(F.asc_nulls_last(named(salt)), "v").limit(n).collect()],
                                    np.int64).reshape(-1, dims)
    centroids, simplex = pick("3", k), Simplex(pick("pivot", SAMPLE))
    width = len(simplex.base) + 1

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apex = simplex.apex(squared(matrix(b.column("v"), dims), simplex.pivots)) if len(b) else np.zeros((0, width))
            yield b.append_column("apex", pa.FixedSizeListArray.from_arrays(pa.array(apex.ravel()), width).cast(pa.list_(pa.float64())))

    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    cached = stage(vectors.mapInArrow(cache, "vec_id long, v array<int>, apex array<double>"), "simplex-vectors")
    for _ in range(rounds):
        n, total = _sums(cached, centroids, simplex, dims)
        moved = np.array([[x // m for x in xs] if m else c.tolist() for m, xs, c in zip(n, total, centroids)], np.int64)
        if (moved == centroids).all():  # the same centroids give the same assignment in all later rounds
            break
        centroids = moved

    def out(ids, v, which, distance):
        yield pa.RecordBatch.from_arrays([ids, pa.array(which), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stage(cached.mapInArrow(_assigning(centroids, simplex, dims, out), "vec_id long, cluster int, distance long"), "simplex-found")
    per = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(c, per.get(c, 0), sum(per.values()), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest())
            for c, p in enumerate(centroids.tolist())]
    # k rows, whatever the input
    small = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
