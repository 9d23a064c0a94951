"""Plain Python versions of the operators, for comparison on small tables."""

import collections
import hashlib
import math
import re
import zlib

from .conftest import LOWER, WORD, words


def quality(text):
    text = text or ""
    w = words(text, lower=False)
    count = collections.Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for k in range(len(w) - 2):
        if count[w[k], w[k + 1], w[k + 2]] > 1:
            inside |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def shares(text, n):
    """Share of the word characters inside windows of n words that occur twice."""
    w = words(text, lower=False)
    grams = [tuple(w[k:k + n]) for k in range(len(w) - n + 1)]
    count = collections.Counter(grams)
    inside = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(n)}
    return sum(len(w[k]) for k in inside) / max(1, sum(map(len, w)))


def components(nodes, links):
    parent = {k: k for k in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in nodes}


def jaccard_components(pairs, n, pct):
    sets = []
    for _, text in pairs:
        w = words(text)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    order = sorted(range(len(pairs)), key=lambda k: pairs[k][0])
    links = [(i, j) for x, i in enumerate(order) for j in order[:x] if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j])]
    rank = {k: r for r, k in enumerate(order)}
    roots = components(range(len(pairs)), [(rank[a], rank[b]) for a, b in links])
    return sorted(((pairs[k][0], len(sets[k]), pairs[order[roots[rank[k]]]][0]) for k in range(len(pairs))), key=repr)


KINDS = [("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
         ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            if (k == 0 and len(m[1]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24):
                out.append((m.start(), k, name, m.end()))
    out.sort()
    text = ",".join(f"{name}:{start}:{end}" for start, _, name, end in out)
    return [sum(o[1] == k for o in out) for k in range(3)] + [hashlib.sha256(text.encode()).hexdigest()], text


def repeats(pairs, length=50):
    low = {}
    for k, t in pairs:
        t = (t or "").encode()
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            low[w] = min(low.get(w, k), k)
    out = []
    for k, t in pairs:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if low[t[i:i + length]] < k:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        kept = bytes(b for b, x in zip(t, gone) if not x)
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def lines(pairs):
    """Lines that have an earlier line with Jaccard 0.8 or more; pairs in document order."""
    seen, out = [], []
    for k, t in pairs:
        n, gone = 0, []
        for no, line in enumerate((t or "").split("\n")):
            s = set(WORD.findall(line.translate(LOWER)))
            if s:
                n += 1
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    gone.append(no)
                seen.append(s)
        out.append((k, n, len(gone), gone))
    return sorted(out, key=repr)


def unigram(pairs):
    """(id, held out, tokens, known, N, base score)."""
    tokens = [(k, words(t) + ["</s>"]) for k, t in pairs]
    out_of = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in pairs}
    count = collections.Counter(x for k, w in tokens if not out_of[k] for x in w)
    n, v = sum(count.values()), len(count)
    return [(k, out_of[k], len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
            for k, w in tokens]


def align(a, b):
    """Best local alignment score: match 2, mismatch -1, gap -1."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, max(new)), new
    return best


def fill(sizes, weights, epochs=3):
    """Capped shares: clamp and share the excess again until none is above its cap."""
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {k: w for k, w in weights.items() if k not in fixed}
        left = total - sum(fixed.values())
        if not rest:
            return fixed
        share = {k: left * w / sum(rest.values()) for k, w in rest.items()}
        over = [k for k in rest if share[k] > epochs * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: epochs * sizes[k] for k in over}
