"""N-gram Jaccard self-join by vertical partitioning.

Two documents link when ``100 * |A and B| >= pct * |A or B|`` over their distinct word shingles.

1. Global order: a bulk exchange counts every shingle's documents; shingles sort by rarity
   (log-scaled count), then hash.  Equal sets form one class and go on as one member.
2. Candidates: only the first ``n - ceil(pct n / 100) + 1`` shingles of a set in that order can
   be the first common one; members that share one, and pass the length and positional filter,
   are candidates.  A group first pairs with its smallest member only; then only pairs across
   components that are still apart are listed, from a share of pivots and then from all.  Every pair of
   different components is tried before the end, so no link that would join two is lost, and a
   group of near copies costs a multiple of its size, not its square.
3. Vertical partitioning: the shingle order is cut into ``FRAGMENTS`` ranges.  For each fragment
   alone, a task counts the candidates' common shingles; partial counts add up per pair.
   Pairs are also dealt by the member that is not the head or pivot, a member with many pivots in
   shares of about ``SHARE`` pairs: a hot head is copied to many cells, no cell grows with a group.
4. Components of the verified links, by star contraction.

Defined results: A-Z is lower-cased; texts shorter than ``n`` words have one shingle, their
whole word sequence; null or empty texts have no shingle, link with nothing and are their own
component; repeated rows are linked by text like any others; null ids sort last, so a
component is named by its smallest non-null id and a lone null id has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .components import components, join_components
from .packs import (answer, ask, bucket_bits, bucket_cuts, frames, get_u32, join_replies, pack, put_u32, squeeze,
                    unframe, unsqueeze)
from .staging import numbered, stage

SHINGLE = 4
PERCENT = 85
FRAGMENTS = 4
CELL_BYTES = 8 << 20
SHARE = 64
U = np.uint64

SETS = "rid long, doc_id long, n int, alone int, h1 long, h2 long, tokens array<long>, places array<int>, body binary"


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of each text."""
    w = tn.tokenize(*tn.flat(column))
    keys, at = tn.ngrams(w, n)
    for k in range(1, n):
        short = np.flatnonzero(w.counts() == k)
        if len(short):
            kk, aa = tn.ngrams(w, k)
            sel = np.isin(aa, w.first[short])
            keys, at = np.concatenate([keys, kk[sel]]), np.concatenate([at, aa[sel]])
    doc = w.doc()[at] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(column) + 1))


def _block_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    col, keys, bounds = batch.column(2), [], [np.zeros(1, np.int64)]
    for lo, hi in tn.chunks(col):
        k, b = shingle_sets(col.slice(lo, hi - lo), n)
        keys.append(k)
        bounds.append(b[1:] + bounds[-1][-1])
    return (np.concatenate(keys) if keys else np.zeros(0, U)), np.concatenate(bounds)


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` + 32 bits: enough to tell rare from frequent, never to decide equality."""
    return keys >> U(32 - bits) << U(32 - bits)


def _ask_counts(bits: int, n: int):
    def keys_of(batch: pa.RecordBatch):
        keys, count = np.unique(_short(_block_sets(batch, n)[0], bits), return_counts=True)
        low = (keys << U(bits) >> U(32)).astype(np.uint32)
        count = np.minimum(count, 65535).astype("<u2")

        def write(a: int, b: int) -> bytes:
            return frames(squeeze(count[a:b]), put_u32(low[a:b]))

        return keys, write

    return keys_of


def _levels(payloads: list[bytes], _blocks: list[int]) -> list[bytes]:
    parts = []
    for p in payloads:
        counts, keys = unframe(p)
        parts.append((get_u32(keys), np.frombuffer(unsqueeze(counts), "<u2")))
    keys = np.concatenate([k for k, _ in parts])
    uniq, inv = np.unique(keys, return_inverse=True)
    df = np.bincount(inv, weights=np.concatenate([c for _, c in parts]).astype(np.float64))
    level = np.minimum(255, np.floor(4 * np.log2(df))).astype(np.uint8)[inv]
    cut = np.cumsum([0] + [len(k) for k, _ in parts])
    return [squeeze(level[cut[i]:cut[i + 1]]) for i in range(len(parts))]


def _prefixes(bits: int, n: int, pct: int):
    def fn(batch: pa.RecordBatch, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, bounds = _block_sets(batch, n)
        known = tn.distinct(_short(keys, bits))
        level = np.concatenate([np.frombuffer(unsqueeze(r), np.uint8) for r in replies]) if replies else np.zeros(0, np.uint8)
        level = level[np.searchsorted(known, _short(keys, bits))].astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(bounds)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((keys, level, doc))
        place = tn.ragged(size)
        reach = size - -(-pct * size // 100) + 1
        sel = (place < np.repeat(reach, size)) & (level[order] > 0)
        tok, pos, of = keys[order][sel], place[sel], doc[sel]
        n_tok = np.bincount(of, minlength=len(size))
        alone = np.bincount(doc[level[order] == 0], minlength=len(size))
        offs = pa.array(np.concatenate([[0], np.cumsum(n_tok)]).astype(np.int32))

        def total(x: np.ndarray) -> np.ndarray:
            c = np.zeros(len(x) + 1, U)
            np.cumsum(x, out=c[1:])
            return (c[bounds[1:]] - c[bounds[:-1]]).view(np.int64)

        texts = batch.column(2).to_pylist()
        body = [squeeze(t.encode()) if k and t else None for t, k in zip(texts, n_tok.tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array(alone.astype(np.int32)),
             pa.array(total(tn.mix(keys))), pa.array(total(tn.mix(keys ^ U(0x5851F42D4C957F2D)))),
             pa.ListArray.from_arrays(offs, pa.array(tok.view(np.int64))),
             pa.ListArray.from_arrays(offs, pa.array(pos.astype(np.int32))), pa.array(body, pa.binary())],
            ["rid", "doc_id", "n", "alone", "h1", "h2", "tokens", "places", "body"])

    return fn


def _may_link(pct: int):
    """Length and positional filter of members x and y that share a token.

    A pair that links passes at its first common token: nothing before it matches, so what
    follows, at places i and j, must be enough alone.
    """
    nx, ny, i, j = (F.col(c).cast("long") for c in ("x.n", "y.n", "x.i", "y.i"))
    return (100 * F.least(nx, ny) >= pct * F.greatest(nx, ny)) & (F.least(nx - i, ny - j) * (100 + pct) >= pct * (nx + ny))


def _segments(n: int):
    """(cell, part, member, hashes) of each candidate, one row per fragment of the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, v, body in zip(*(c.to_pylist() for c in b.columns)):
                keys, _ = shingle_sets(pa.array([unsqueeze(body).decode()]), n)
                cut = bucket_cuts(keys, int(np.log2(FRAGMENTS)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell] * FRAGMENTS, pa.int32()), pa.array(range(FRAGMENTS), pa.int32()),
                     pa.array([v] * FRAGMENTS, pa.int64()),
                     pa.array([keys[cut[k]:cut[k + 1]].tobytes() for k in range(FRAGMENTS)], pa.binary())],
                    ["cell", "part", "v", "keys"])

    return run


def _overlap(pairs: pa.Table, segs: pa.Table) -> pa.Table:
    """Common shingles of each pair inside one fragment."""
    names = ["a", "b", "common"]
    if not pairs.num_rows or not segs.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names)
    raw = segs.column("keys").to_pylist()
    ids = segs.column("v").to_numpy()
    order = np.argsort(ids)
    keys = [np.frombuffer(raw[k], U) for k in order.tolist()]
    ids = ids[order]
    size = np.array([len(k) for k in keys])
    start = np.cumsum(size) - size
    flat = np.concatenate(keys)
    salt = tn.mix(np.arange(len(ids), dtype=U) + U(1))
    known = np.sort(tn.mix(flat ^ np.repeat(salt, size)))
    a, b = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in ("a", "b"))
    common = np.zeros(len(a), np.int64)
    step = max(1, (1 << 20) // max(1, int(size.max())))
    for lo in range(0, len(a), step):
        x, y = a[lo:lo + step], b[lo:lo + step]
        x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
        n = size[x]
        probe = tn.mix(flat[np.repeat(start[x], n) + tn.ragged(n)] ^ np.repeat(salt[y], n))
        at = np.searchsorted(known, probe)
        at[at == len(known)] = 0
        hit = known[at] == probe if len(known) else np.zeros(0, bool)
        common[lo:lo + step] = np.bincount(np.repeat(np.arange(len(x)), n)[hit], minlength=len(x))
    return pa.table([pairs.column("a"), pairs.column("b"), pa.array(common)], names)


def _verify(pairs: DataFrame, bodies: DataFrame, n: int, pct: int) -> DataFrame:
    """The pairs (a, b, na, nb, deal) that reach the similarity, by partial counts per fragment."""
    size = pairs.agg(F.sum(F.col("na").cast("long") + F.col("nb"))).first()[0] or 0
    cells = max(8, -(-size * 8 // (CELL_BYTES * FRAGMENTS)))
    dealt = pairs.withColumn("cell", F.pmod("deal", F.lit(cells)).cast("int"))
    need = dealt.select("cell", F.col("b").alias("v")).unionByName(dealt.select("cell", F.col("a").alias("v"))).distinct()
    segs = need.join(bodies, "v").select("cell", "v", "body").mapInArrow(_segments(n), "cell int, part int, v long, keys binary")
    parts = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)))).select("cell", "part", "a", "b")
    counted = parts.groupBy("cell", "part").cogroup(segs.groupBy("cell", "part")).applyInArrow(_overlap, "a long, b long, common long")
    total = counted.groupBy("a", "b").agg(F.sum("common").alias("common"))
    return pairs.join(total, ["a", "b"]).filter(100 * F.col("common") >= pct * (F.col("na") + F.col("nb") - F.col("common"))) \
        .select("a", "b")


def link(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``."""
    packs = pack(docs, "ngram-packs", id_col, text_col)
    bits = bucket_bits(packs)
    levels = answer(ask(packs, bits, _ask_counts(bits, shingle)), _levels)
    sets = stage(join_replies(packs, levels, _prefixes(bits, shingle, percent), SETS), "ngram-sets")
    full = sets.filter("n > 0")

    pair = F.explode(F.arrays_zip("tokens", "places"))
    # a member of a token's group: few lone shingles first, so that heads are near the others
    member = F.struct(F.col("alone").alias("u"), F.col("v"), F.col("n"), F.col("i"))
    groups = (full.select("rid", "n", "alone", "h1", pair.alias("t"))
              .groupBy(F.col("t.tokens").alias("token"), "h1", "n", F.col("t.places").alias("i"), "alone")
              .agg(F.min("rid").alias("v")).select("token", member.alias("m")))
    heads = groups.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("m").alias("head")).filter("size > 1")
    groups = stage(groups.join(heads, "token").select("token", "m", "head"), "ngram-groups")

    def as_pairs(df: DataFrame) -> DataFrame:
        """Distinct pairs of the members x and y that may link, dealt by x in ``shares`` shares of its y."""
        x, y = F.struct("x.v", "x.n"), F.struct("y.v", "y.n")
        deal = F.xxhash64("x.v", F.pmod(F.xxhash64("y.v", F.lit(1)), F.col("shares")))
        return (df.filter(_may_link(percent)).select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q"), deal.alias("deal"))
                .groupBy(F.col("p.v").alias("a"), F.col("q.v").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"))
                .agg(F.min("deal").alias("deal")))

    members = stage(groups.select("m.v", "m.n").distinct(), "ngram-members")
    bodies = stage(full.select(F.col("rid").alias("v"), "body").join(members.select("v"), "v", "left_semi"), "ngram-bodies")

    pairs = stage(as_pairs(groups.filter("m.v != head.v").select(F.col("m").alias("x"), F.col("head").alias("y"), F.lit(1).alias("shares"))), "ngram-pairs")
    roots = components(stage(_verify(pairs, bodies, shingle, percent), "ngram-links"))
    tried, share = pairs, 1
    while True:
        now = groups.select("token", "m", F.col("m.v").alias("node")).join(roots, "node", "left") \
            .select("token", "m", F.coalesce("root", "node").alias("root"))
        apart = now.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")) \
            .filter("r0 < r1")
        live = stage(now.join(apart.select("token", "size"), "token"), "ngram-live")
        seen = live.agg(F.count(F.lit(1)), F.sum("size")).first()
        if not seen[0]:
            break
        # all cross pairs at once while they are few for each row, else some pivots first
        share = 64 if seen[1] <= 16 * seen[0] else share
        pivots = live.filter(F.pmod(F.xxhash64("m.v"), F.lit(64)) < share).select("token", F.col("m").alias("y"), F.col("root").alias("other"))
        shares = (F.col("size") * share / (64 * SHARE)).cast("long") + 1
        new = live.select("token", F.col("m").alias("x"), "root", shares.alias("shares")).join(pivots, "token").filter("root != other")
        pairs = stage(as_pairs(new).join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        tried = tried.unionByName(pairs)
        links = stage(_verify(pairs, bodies, shingle, percent), "ngram-links")
        roots = join_components(roots, links)
        if share >= 64:
            break
        share = 64

    first = full.groupBy("n", "h1", "h2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"))
    named = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = stage(named.join(lowest, "root").select("n", "h1", "h2", "component_id"), "ngram-classes")
    got = full.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"])
    none = sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return got.select("doc_id", "n", "component_id").unionByName(none).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` with one row of each component (all columns): that of the smallest id, null ids last.
    Decided by row: rows that repeat an id or have none count like any others."""
    rows, row = numbered(docs, "ngram-rows")
    comp = stage(link(rows, id_col=row, **kw).select(F.col("doc_id").alias("r"), "component_id"), "ngram-kept")
    ids = rows.select(F.col(row).alias("r"), F.col(id_col).alias("id"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("r").alias("row"))
    first = (comp.join(ids, "r").groupBy("component_id")
             .agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("component_id", F.col("b.row").alias("keep")))
    gone = comp.join(first, "component_id").filter("r != keep").select(F.col("r").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
