"""``score`` of the language model against a plain deleted interpolation."""

import collections
import math
import zlib

import pytest

from quarry.llm import op4_interpolation

from .conftest import SF, pairs_of, edge_rows, words


def interpolated(pairs):
    """(id, log10 probability) of every text: bigrams, unigrams and a floor, mixed by the context's frequency."""
    fold = lambda k: None if k is None else zlib.crc32(str(k).encode()) % 7
    texts = [(k, words(t) + ["</s>"]) for k, t in pairs]
    steps = lambda seq: zip(["<s>"] + seq[:-1], seq)

    def counts(keep):
        one, two, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for k, seq in texts:
            if keep(fold(k)):
                for h, w in steps(seq):
                    one[w] += 1
                    two[h, w] += 1
                    ctx[h] += 1
        return one, two, ctx, sum(one.values()), len(one)

    bucket = lambda c: int(math.log2(c)) + 1 if c else 0
    one, two, ctx, n, v = counts(lambda f: f not in (2, 3))
    seen = collections.defaultdict(collections.Counter)
    for k, seq in texts:
        if fold(k) == 3:
            for h, w in steps(seq):
                ratio = lambda p: round(16 * math.log2(p * (v + 1))) if p else None
                seen[bucket(ctx[h])][ratio(two[h, w] / max(ctx[h], 1)), ratio(one[w] / max(n, 1))] += 1
    weights = {}
    for b, hist in seen.items():
        a = [1 / 3] * 3 if b else [0.0, 0.5, 0.5]
        like = [((0 if r2 is None else 2 ** (r2 / 16), 0 if r1 is None else 2 ** (r1 / 16), 1), m) for (r2, r1), m in hist.items()]
        for _ in range(500):
            new = [1.0 if x > 0 else 0.0 for x in a]
            for p, m in like:
                total = sum(x * y for x, y in zip(a, p))
                new = [x + m * y * z / total for x, y, z in zip(new, a, p)]
            new = [x / sum(new) for x in new]
            done = max(abs(x - y) for x, y in zip(a, new)) < 1e-9
            a = new
            if done:
                break
        weights[b] = a
    one, two, ctx, n, v = counts(lambda f: f != 2)

    def weight(b):
        # a bucket without evidence takes the nearest smaller one's; those under the first seen share alike
        if b == 0:
            return weights.get(0, [0.0, 0.5, 0.5])
        for k in range(b, 0, -1):
            if k in weights:
                return weights[k]
        return [1 / 3] * 3

    out = []
    for k, seq in texts:
        total = 0.0
        for h, w in steps(seq):
            a = weight(bucket(ctx[h]))
            total += math.log10(a[0] * two[h, w] / max(ctx[h], 1) + a[1] * one[w] / max(n, 1) + a[2] / (v + 1))
        out.append((k, total))
    return out


@pytest.mark.parametrize("which", ["table", "edge"])
def test_score_is_the_interpolation(spark, edge, docs, which):
    frame, pairs = (spark.read.parquet(f"{SF}/documents.parquet"), pairs_of(docs)) if which == "table" else (edge, pairs_of(edge_rows()))
    got = sorted(((r["doc_id"], r["score"]) for r in op4_interpolation.score(frame).collect()), key=repr)
    want = sorted(interpolated(pairs), key=repr)
    assert [k for k, _ in got] == [k for k, _ in want]
    for (_, x), (_, y) in zip(got, want):
        assert x == pytest.approx(y, rel=1e-6)
