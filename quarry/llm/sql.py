"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

import string

from .op1_quality import MAX_LINE_SHARE, MAX_SHARE, MIN_WORDS, SHARES
from .op5_secrets import ASSIGN_MIN, BASE, COPIED_OWNERS, COPIED_REPOS, KINDS, MIN_CHARACTERS, PLACEHOLDER
from .op8_ngram_join import PERCENT, SHINGLE
from .op12_prefix_trie import HEADS, SHELF
from .op13_simplex_clusters import DIMS, K, ROUNDS, SCALE

WORD = r"[^\x20\x09-\x0D]+"
LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _windows(n: int) -> str:
    """Words inside windows of n words that occur twice: characters and count per document."""
    return f"""
g{n} AS (SELECT doc_id, i, ws[i:i + {n - 1}] AS g FROM w, unnest(range(1, len(ws) - {n - 2})) t(i) WHERE len(ws) >= {n}),
r{n} AS (SELECT doc_id, unnest(list(i)) AS i FROM g{n} GROUP BY doc_id, g HAVING count(*) > 1),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(ws[k])) AS chars
         FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS k FROM r{n}) JOIN w USING (doc_id) GROUP BY doc_id)"""


def quality() -> str:
    lens = [3, *MAX_SHARE]
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in lens)
    total = "greatest(word_chars, 1)"
    share = ", ".join(f"coalesce(c{n}.chars, 0) / {total} AS {s}" for n, s in zip(MAX_SHARE, SHARES))
    over = " OR ".join([f"dup_line_share > {MAX_LINE_SHARE}"] + [f"{s} > {m}" for s, m in zip(SHARES, MAX_SHARE.values())])
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
{','.join(_windows(n) for n in lens)},
l AS (SELECT doc_id, k, lines[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM w), unnest(range(1, len(lines) + 1)) t(k)
      WHERE regexp_matches(lines[k], '{WORD}')),
d AS (SELECT doc_id, count(*) - 1 AS again, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars FROM l GROUP BY doc_id, line),
dl AS (SELECT doc_id, sum(again) AS n_dup_lines, sum(again * chars) AS chars FROM d GROUP BY doc_id),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dl.n_dup_lines, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words,
             coalesce(dl.chars, 0) / {total} AS dup_line_share, {share} FROM b LEFT JOIN dl USING (doc_id) {joins}),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({over}) AS kept FROM f
"""


def _pattern(kind: str, pattern: str) -> str:
    """The same pattern with letter classes instead of a case switch (A-Z only)."""
    if kind == "assign":
        words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                         for w in ("password", "passwd", "secret", "token", "api_?key"))
        pattern = f"(?:{words})" + pattern.split(")", 1)[1]
    return pattern.replace("'", "''")


def secrets() -> str:
    parts, cands = [], []
    for k, (kind, pattern, group) in enumerate(KINDS):
        p = _pattern(kind, pattern)
        parts.append(f"""
m{k} AS (SELECT doc_id, owner, repo, p, m, v FROM (
  SELECT doc_id, owner, repo, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v
  FROM d WHERE regexp_matches(text, '{p}'))),
s{k} AS (SELECT doc_id, owner, repo, i, length(p[i]) AS gap, length(m[i]) AS len, v[i] AS value FROM m{k}, unnest(range(1, len(m) + 1)) t(i)),
e{k} AS (SELECT doc_id, owner, repo, {k} AS kind, '{kind}' AS name, value, len,
                CAST(sum(gap + len) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM s{k})""")
        cands.append(f"SELECT * FROM e{k}" + (f" WHERE length(value) >= {ASSIGN_MIN}" if kind == "assign" else ""))
    one = "name || ':' || (stop - len) || ':' || stop"
    order = "(stop - len) * 8 + kind"
    fake = f"regexp_matches(value, '{PLACEHOLDER}') OR len(list_distinct(string_split(value, ''))) < {MIN_CHARACTERS}"
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = {k}), 0) AS n_{KINDS[k][0]}" for k in range(BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
{','.join(parts)},
c AS ({' UNION ALL '.join(cands)}),
o AS (SELECT value, count(DISTINCT owner) >= {COPIED_OWNERS} OR count(DISTINCT (owner, repo)) >= {COPIED_REPOS} AS copied FROM c GROUP BY value),
a AS (SELECT c.*, CASE WHEN copied THEN 'copied' WHEN {fake} THEN 'placeholder' ELSE 'live' END AS label FROM c JOIN o USING (value)),
k AS (SELECT * FROM a WHERE kind < {BASE} OR label = 'live'),
g AS (SELECT doc_id, {counts},
             string_agg({one}, ',' ORDER BY {order}) FILTER (WHERE kind < {BASE}) AS base,
             string_agg({one}, ',' ORDER BY {order}) AS spans, string_agg(label, ',' ORDER BY {order}) AS labels,
             count(*) FILTER (WHERE label = 'live') AS n_live
      FROM k GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{KINDS[k][0]}, 0) AS n_{KINDS[k][0]}' for k in range(BASE))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(labels, '') AS labels, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (doc_id)
"""


def ngram_join() -> str:
    n = SHINGLE
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i + {n - 1}] AS g FROM w, unnest(range(1, greatest(len(ws) - {n - 2}, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


def stream_dedup() -> str:
    return f"""
WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


def prefix_trie() -> str:
    """Prefixes as lists of turn hashes; sums over subtrees by a join of every node with its ancestors."""
    crc = ("xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), "
           "lambda s: [ascii(s), -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)")
    return f"""
WITH t AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
                  length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, m, len, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS i FROM t),
h AS (SELECT c, c - ((c % {SHELF}) + {SHELF}) % {SHELF} AS base, CAST({crc} AS BIGINT) % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS part, i, m, len FROM h JOIN o ON o.c = h.base AND i <= h UNION ALL SELECT h.c, 1, i, m, len FROM h JOIN o ON o.c = h.c AND i > h),
p AS (SELECT h.c, coalesce(list(m ORDER BY part, i) FILTER (WHERE m IS NOT NULL), []) AS ms,
             coalesce(list(len ORDER BY part, i) FILTER (WHERE m IS NOT NULL), []) AS ls FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
x AS (SELECT c, d, ms[1:d] AS k, CASE WHEN d > 0 THEN ls[d] ELSE 0 END AS len, d = len(ms) AS ends FROM p, unnest(range(0, len(ms) + 1)) u(d)),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM x GROUP BY k, d),
ch AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
s AS (SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * len) AS saved_tokens
      FROM f, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (k) LEFT JOIN n q ON f.d > 0 AND q.k = f.k[1:f.d - 1]
"""


def clusters() -> str:
    """One pair of steps per round, written out."""
    parts = [f"""
v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v AS p
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {K}))"""]
    dist = "list_sum(list_transform(list_zip(v, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        parts.append(f"""
d{i} AS MATERIALIZED (SELECT r, arg_min(k, d * {K} + k) AS k, CAST(min(d) AS BIGINT) AS d FROM (SELECT r, k, {dist} AS d FROM v CROSS JOIN c{i}) GROUP BY r)""")
        if i < ROUNDS:
            parts.append(f"""
u{i} AS (SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM d{i} JOIN v USING (r), unnest(range(1, {DIMS + 1})) t(i) GROUP BY k, i),
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM u{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.p, c{i}.p) AS p FROM c{i} LEFT JOIN m{i} USING (k))""")
    last = ROUNDS
    return f"""
WITH {','.join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
FROM d{last} JOIN v USING (r) JOIN c{last} USING (k)
"""
