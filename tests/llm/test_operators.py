"""Each operator against brute force, on the driver's small table and on edge rows."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import (op1_quality, op2_mix, op3_tokens, op4_interpolation, op5_secrets, op6_repeats, op7_lines,
                        op8_ngram_join, op9_licenses, op10_decontam)
from quarry.llm import textnp as tn

from . import brute
from .conftest import BASE, edge_rows, pairs_of, rows_of, words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
EDGE = pairs_of(edge_rows())


def both(spark, edge, docs):
    """(frame, pairs) of the driver's documents and of the edge rows."""
    from .conftest import SF

    return [(spark.read.parquet(f"{SF}/documents.parquet"), pairs_of(docs)), (edge, EDGE)]


def test_quality(spark, edge, docs):
    cols = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    for frame, pairs in both(spark, edge, docs):
        want = sorted(((k, *brute.quality(t)) for k, t in pairs), key=repr)
        got = op1_quality.measure(frame)
        assert rows_of(got, "doc_id", *cols) == want
        text = dict(pairs)
        for r in got.collect():
            for n in (5, 8, 10):
                assert r[f"dup_share_{n}"] == pytest.approx(brute.shares(text[r["doc_id"]], n))


def test_quality_keep_has_the_input_columns(edge):
    kept = op1_quality.keep(edge)
    assert kept.columns == edge.columns
    ids = {r["doc_id"] for r in op1_quality.measure(edge).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == ids and 6 in ids and 0 not in ids


def test_long_text_is_hashed_in_pieces():
    text = " ".join(f"w{i % 1000}" for i in range(300_000)) + "\nend\nend"
    m = op1_quality.measures(pa.array(["x", text]))
    assert m["n_words"][1] == 300_002 and m["n_dup_lines"][1] == 1 and m["n_repeat_words"][1] == 300_000


def test_mix(spark, edge, docs):
    for frame, pairs in both(spark, edge, docs):
        src = {(r["doc_id"], r["text"]): r["source"] for r in frame.select("doc_id", "text", "source").collect()}
        size, per = {}, {}
        for k, t in pairs:
            s = src[k, t]
            per[s] = per.get(s, 0) + len(words(t))
        names = sorted((s for s in per if s is not None)) + [s for s in per if s is None]
        want = brute.fill(per, {s: i % 3 + 1 for i, s in enumerate(names)})
        got = op2_mix.mix(frame).collect()
        assert len(got) == len(pairs)
        taken = {s: 0 for s in per}
        most = {s: 0 for s in per}
        for r in got:
            s = r["source"]
            assert r["source_size"] == per[s] and r["target"] == pytest.approx(want[s])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[s] += r["taken"]
            most[s] = max(most[s], r["size"])
        for s in per:
            assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
        assert rows_of(op2_mix.mix(frame), "doc_id", "size", "taken") == sorted(
            ((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)


def test_mix_output_repeats_rows(edge):
    plan, times = {}, {}
    for r in op2_mix.mix(edge).collect():
        plan[r["doc_id"]] = max(plan.get(r["doc_id"], 0), r["copies"])
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    out = op2_mix.apply_mix(edge)
    assert out.columns == edge.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: n * times[k] for k, n in plan.items() if n} and times[6] == 2


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32 - 1])
def test_block_codec_round_trip(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 127, 128, 129, 4000):
        ids = rng.integers(0, high, n).astype(np.uint32)
        assert (op3_tokens.decode_blocks(op3_tokens.encode_blocks(ids)) == ids).all()
    ids = np.full(1000, 7, np.uint32)
    ids[::37] = 2**32 - 1
    assert (op3_tokens.decode_blocks(op3_tokens.encode_blocks(ids)) == ids).all()


def test_tokens(spark, edge, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    for frame, pairs in both(spark, edge, docs):
        start, want = 0, []
        for k, t in sorted(pairs, key=lambda p: p[0]):
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = op3_tokens.read(op3_tokens.write(frame, TOKENIZER))
        assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_tokens_of_special_literals(spark):
    """The literal of a special token gets the ids that the library gives, wherever it stands."""
    from tokenizers import Tokenizer

    tok, end = Tokenizer.from_file(TOKENIZER), "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x{end}y z", f"a\n{end}\nb", f"a  {end}  b", f" {end} ", f"{end}\n\n {end}'s",
             f"one two {end}three {end} four\n{end} five", f"\t{end}\u00a0{end}\r\n", "<|endof text|> <|endoftext |>"]
    texts += [f"{a}{end}{b}" for a in ("w", " ", "\n", "w ", "w\n", " \n", "\u00e9") for b in ("w", " ", "\n", " w", "\nw", "\n ", "'ll")]
    start, want = 0, []
    for k, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert tok.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = op3_tokens.read(op3_tokens.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER))
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_language_model(spark, edge, docs):
    for frame, pairs in both(spark, edge, docs):
        got = {}
        for r in op4_interpolation.score(frame).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for k, held, n, known, total, base in brute.unigram(pairs):
            r = got[k][0]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
            assert r["base_score"] == pytest.approx(base)
    # held-out accuracy: the mixture beats the base model on texts it has not seen
    frame, pairs = both(spark, edge, docs)[0]
    out = [r for r in op4_interpolation.score(frame).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_mixture_weights_are_a_maximum():
    import pandas as pd

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"bucket": 4, "r2": rng.integers(-40, 200, 60), "r1": rng.integers(-20, 120, 60), "n": rng.integers(1, 50, 60)})
    a = op4_interpolation._maximise(pdf).iloc[0][["a2", "a1", "a0"]].to_numpy(float)

    def fit(w):
        like = w[0] * np.exp2(pdf.r2 / 16) + w[1] * np.exp2(pdf.r1 / 16) + w[2]
        return (pdf.n * np.log(like)).sum() + np.log(np.maximum(w, 1e-300)).sum()

    assert a.sum() == pytest.approx(1)
    for _ in range(200):
        w = np.abs(a + rng.normal(0, 0.02, 3))
        assert fit(w / w.sum()) <= fit(a) + 1e-6


def test_secrets(spark, edge, docs):
    for frame, pairs in both(spark, edge, docs):
        got = op5_secrets.scan(frame)
        want = sorted(((k, *brute.base_spans(t)[0]) for k, t in pairs), key=repr)
        assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
        text = dict(pairs)
        for r in got.collect():
            base = brute.base_spans(text[r["doc_id"]])[1]
            assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_secret_ownership(spark):
    rows = [(i, f"x password=sharedvalue1 {'ghp_' + 'a1X' * 13}", f"s{i}", "en") for i in range(4)]
    rows.append((9, "password=ownvalue99 ghp_" + "Zz" * 20, "s9", "en"))
    got = {r["doc_id"]: r for r in op5_secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[0]["spans"] == "assign:2:23" and got[0]["n_live"] == 0  # widely copied: base stays, added kind goes
    assert got[9]["spans"] == "assign:0:19,provider:20:64" and got[9]["n_live"] == 2


def test_repeats(spark, edge, docs):
    for frame, pairs in both(spark, edge, docs):
        got = op6_repeats.dedup(frame)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(pairs)


def test_maximal_repeats_by_definition():
    rng = np.random.default_rng(5)
    for _ in range(20):
        texts = ["".join(rng.choice(list("ab"), rng.integers(1, 40))).replace("b", "\0") for _ in range(3)]
        buf = np.frombuffer("".join(texts).encode(), np.uint8)
        size = np.array([len(t) for t in texts])
        end = np.cumsum(size)
        of = np.repeat(np.arange(3), size)
        got = {(int(n), tuple(sorted(at[a:b].tolist()))) for lengths, bounds, at in op6_repeats.maximal_repeats(buf, (end - size)[of], end[of], 3)
               for n, a, b in zip(lengths, bounds, bounds[1:])}
        want, begin = set(), end - size
        found = {}
        for k, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + 3, len(t) + 1):
                    found.setdefault(t[i:j], []).append(begin[k] + i)
        for s, at in found.items():
            if len(at) > 1:
                left = {texts[of[p]][p - begin[of[p]] - 1] if p > begin[of[p]] else ("edge", p) for p in at}
                right = {texts[of[p]][p - begin[of[p]] + len(s)] if p + len(s) < end[of[p]] else ("edge", p) for p in at}
                if len(left) > 1 and len(right) > 1:
                    want.add((len(s), tuple(sorted(int(p) for p in at))))
        assert got == want


def test_wide_anchors_give_the_same(spark, edge, docs):
    """With every shared anchor treated as very wide, 50-byte strings are compared by hash."""
    for frame, pairs in both(spark, edge, docs):
        got = op6_repeats.dedup(frame, wide=1)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(pairs)


def test_repeats_first_seen_inside_removed_bytes(spark):
    """A document whose removed ranges meet still gives later ones the strings across the seam."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        x, a, b = ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n)) for n in (400, 80, 80))
        rows += [(10 * k + 1, x[:200]), (10 * k + 2, x[180:]), (10 * k + 5, x), (10 * k + 9, a + "#" + x[150:215] + "#" + b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.repeats(rows)
    assert {r[2] for r in want if r[0] % 10 == 9} == {65}
    for wide in (op6_repeats.WIDE, 1):
        got = op6_repeats.dedup(frame, wide=wide)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_lines(spark, edge, docs):
    for frame, pairs in both(spark, edge, docs):
        want = brute.lines(sorted(pairs, key=lambda p: p[0]))
        assert rows_of(op7_lines.dedup(frame), "doc_id", "n_lines", "n_removed", "removed") == want


def test_line_candidates_with_frequent_tokens(monkeypatch):
    """Frequent tokens meet in pairs only; all similar lines still meet."""
    rng = np.random.default_rng(2)
    vocab = [f"v{i}" for i in range(12)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 9))) for _ in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array(["\n".join(texts)])], ["rid", "doc_id", "text"])
    for hot in (4, 10, 1000):
        monkeypatch.setattr(op7_lines, "HOT", hot)
        monkeypatch.setattr(op7_lines, "FIRST", 10**6)
        m = op7_lines.Members(batch, lambda v: (v % np.uint64(13) + np.uint64(1)).astype(np.uint8))
        sets = [set(m.token[s:s + n].tolist()) for s, n in zip(m.start, m.size)]
        key, who, place = m.entries()
        met = {}
        for k, w in zip(key.tolist(), who.tolist()):
            met.setdefault(k, set()).add(w)
        for i in range(len(sets)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    assert any(i in g and j in g for g in met.values())

        e = {"id": who, "n": m.size[who], "place": place} | {c: x[who] for c, x in zip(op7_lines.SKETCH, m.map)}
        y, x = (g.ravel() for g in np.meshgrid(np.arange(len(who)), np.arange(len(who)), indexing="ij"))
        y, x = y[key[y] == key[x]], x[key[y] == key[x]]
        ok = op7_lines._pass(e, y, x)[0]
        passed = set(zip(who[y[ok]].tolist(), who[x[ok]].tolist()))
        assert all((i, j) in passed for i in range(len(sets)) for j in range(len(sets))
                   if i != j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))


def test_blocks_of_lines_are_read_into_words_once(monkeypatch):
    """A kept block gives the same line sets as its texts, without reading them again."""
    from quarry.llm import packs

    rows = [(None if r["doc_id"] in (3, 7) else r["doc_id"], r["text"]) for r in edge_rows()]
    rows += [(50, "\n".join(f"{a} {b} {a}" for a in "xyzXYZ" for b in "uvw")), (50, "u x\n\nx u"), (51, "\n \n")]
    monkeypatch.setattr(op7_lines.tn.chunks, "__defaults__", (1 << 9,))
    for part in (rows, rows[:2]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(1 << 40, (1 << 40) + len(part))), pa.array([r[0] for r in part], pa.int64()),
                                            pa.array([r[1] for r in part], pa.string())], ["rid", "doc_id", "text"])
        whole = op7_lines.Lines(batch)
        assert (len(whole.row) == 0) == (part is not rows)
        kept = packs.unseal(packs.seal(op7_lines._kept(batch), 1))
        assert kept.column(0).to_pylist() == [1 << 40]
        with monkeypatch.context() as m:
            m.setattr(op7_lines.tn, "tokenize", None)
            again = op7_lines.Lines(kept)
            members = op7_lines.Members(kept, lambda v: np.ones(len(v), np.uint8))
        for name in vars(whole):
            assert getattr(again, name).tolist() == getattr(whole, name).tolist(), name
        assert [x.tolist() for x in members.map] == [x.tolist() for x in whole.sketches()]
        # the sketch of a set is the parity of its words' bits, folded
        for k, (at, n) in enumerate(zip(whole.start().tolist(), whole.size.tolist())):
            bits = [0] * 8
            for w in whole.vocab[whole.code[at:at + n]].tolist():
                bits[w >> 6 & 7] ^= 1 << (w & 63)
            kept_words = 1 if n <= op7_lines.ONE_WORD else 2 if n <= op7_lines.TWO_WORDS else 8
            want = [0] * 8
            for j, b in enumerate(bits):
                want[j % kept_words] ^= b
            assert [int(x[k]) for x in members.map] == want


def test_lines_that_need_every_pass(spark):
    """Many near lines that are not similar: members stop early, and some find their earlier line in the last pass."""
    rng = np.random.default_rng(1)
    rows = []
    for d in range(250):
        lines = []
        for _ in range(4):
            base = [f"t{i}" for i in range(16)] if rng.random() < .7 else [f"u{i}" for i in range(int(rng.integers(5, 25)))]
            for j in rng.choice(len(base), int(rng.integers(0, 4)), replace=False):
                base[j] = f"z{rng.integers(0, 12)}"
            lines.append(" ".join(base))
        rows.append((d, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(op7_lines.dedup(frame), "doc_id", "n_lines", "n_removed", "removed") == brute.lines(rows)


def test_ngram_join(spark, edge, docs):
    for frame, pairs in both(spark, edge, docs):
        got = rows_of(op8_ngram_join.link(frame), "doc_id", "n_shingles", "component_id")
        assert got == brute.jaccard_components(pairs, 4, 85)


def test_ngram_join_chains(spark):
    """Near copies that link only through others, and a group whose head is unlike the rest."""
    w = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(12):
        body = list(w)
        for j in range(k):
            body[5 + 9 * j] = f"z{j}"
        rows.append((k, " ".join(body)))
    rows += [(50 + k, " ".join(w[:60] + [f"q{k}{i}" for i in range(60)])) for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for n, pct in ((4, 85), (5, 80), (2, 60)):
        got = rows_of(op8_ngram_join.link(frame, shingle=n, percent=pct), "doc_id", "n_shingles", "component_id")
        assert got == brute.jaccard_components(rows, n, pct)


def test_ngram_join_cells_do_not_grow_with_a_group(spark, monkeypatch, tmp_path):
    """A head read after all its near copies: its pairs are spread over the cells."""
    w = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join([*w[:100], f"own{k}", *w[101:]])) for k in range(300)] + [(900, " ".join(w)), (901, " ".join([*w, "end"]))]
    inner = op8_ngram_join._segments

    def segments(n):
        run = inner(n)

        def counted(batches):
            import uuid

            def note(b):
                (tmp_path / uuid.uuid4().hex).write_text(" ".join(map(str, b.column(0).to_pylist())))
                return b

            yield from run(note(b) for b in batches)

        return counted

    monkeypatch.setattr(op8_ngram_join, "_segments", segments)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = rows_of(op8_ngram_join.link(frame), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_components(rows, 4, 85)
    cells = [c for f in tmp_path.iterdir() for c in f.read_text().split()]
    assert len(cells) > 300 and max(map(cells.count, set(cells))) < len(cells) / 3


def test_licences(spark):
    rows = [(1, "a/b/c/f.py", "code\nReleased under the MIT License.\nmore " + BASE + BASE), (2, "a/b/g.py", BASE + BASE),
            (3, "a/LICENSE", "Licensed under the Apache License, Version 2.0.\n" + BASE + BASE), (4, "a/b/c/d/h.py", None), (5, "z/i.py", ""),
            (6, "a/b/NOTICE", "This work is licensed under the GNU General Public License, version 3."), (7, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("licence", F.lit("clash"))
    got = {r["doc_id"]: (r["own_licence"], r["licence"], r["from_dir"]) for r in op9_licenses.scan(frame, F.col("path")).collect()}
    assert got == {1: ("MIT", "MIT", "own"), 2: (None, "GPL-3.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", "own"),
                   4: (None, "GPL-3.0", "a/b"), 5: (None, None, None), 6: ("GPL-3.0", "GPL-3.0", "own"), 7: (None, None, None)}


def test_licence_scores_by_brute_force(spark, edge):
    """Every line of every document, scored plainly with the same weights."""
    import math
    import re

    got = {r["doc_id"]: r for r in op9_licenses.scan(edge, F.lit("p/x")).collect()}
    idf, unseen = op9_licenses.term_weights(edge.select(F.col("text").alias("_body")), F.coalesce(F.col("_body"), F.lit("")))
    for k, text in EDGE:
        best = (0, None)
        for line in (text or "").split("\n"):
            tf = {}
            for t in re.findall(op9_licenses.TERM, line.lower()):
                tf[t] = tf.get(t, 0) + 1
            norm = math.sqrt(sum((c * idf.get(t, unseen)) ** 2 for t, c in tf.items()))
            for name, _, want in op9_licenses.statements():
                unit = math.sqrt(sum((c * idf[t]) ** 2 for t, c in want.items()))
                dot = sum(c * idf[t] * tf.get(t, 0) * idf[t] for t, c in want.items())
                if norm and dot / norm / unit >= op9_licenses.MIN_COSINE:
                    best = min(best, (-round(dot / norm / unit, 9), name), key=lambda b: (b[0], b[1] or ""))
        assert got[k]["own_licence"] == best[1]


def test_licences_beside_other_text(spark):
    """Statements among other words of their line, and statements over several comment lines."""
    gpl = "# This work is licensed under the GNU\n# General Public License,\n# version 3, as follows"
    rows = [(1, "Copyright Ada Byron and others 1843 all of it Released under the MIT License. See notes below for more details"),
            (2, BASE + "\n" + gpl + "\n" + BASE), (3, "the License of this version is permitted"), (4, "MIT License\n" + BASE),
            (5, "x // Licensed under\n// the Apache License,\n// Version 2.0 (the licence)")]
    rows += [(k, f"copyright holder{k} and others see notes below for word{k}") for k in range(10, 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in op9_licenses.scan(frame, F.lit("p/x")).collect()}
    assert {k: got[k]["own_licence"] for k in (1, 2, 4, 5)} == {1: "MIT", 2: "GPL-3.0", 4: "MIT", 5: "Apache-2.0"}
    assert got[1]["score"] == got[2]["score"] == got[5]["score"] == 1.0
    assert got[3]["own_licence"] is None and all(got[k]["own_licence"] is None for k in range(10, 400))


def test_alignment_against_plain_dynamic_programme():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 6, (40, 12)).astype(np.uint64)
    b = rng.integers(1, 6, (40, 20)).astype(np.uint64)
    la, lb = rng.integers(1, 13, 40), rng.integers(1, 21, 40)
    got = op10_decontam.align(a, la, b, lb)
    assert got.tolist() == [brute.align(a[i, :la[i]].tolist(), b[i, :lb[i]].tolist()) for i in range(40)]


def test_decontamination(spark):
    noise = " ".join(f"n{i}" for i in range(200))
    item = BASE.split()
    edited = list(item)
    for k in range(3, len(item), 9):
        edited[k] = "changed"
    rows = [(1, f"{noise} {BASE.upper()} {noise}"), (2, f"{noise} {' '.join(edited)}"), (3, noise), (4, None), (5, ""),
            (6, " ".join(item[:len(item) * 2 // 3])), (7, " ".join(item[:8]) + " " + noise), (8, "uno dos"), (None, BASE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("x"))
    bench = spark.createDataFrame([(10, BASE), (11, BASE), (12, None), (13, ""), (14, "uno dos")], "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = {(r["doc_id"], r["item_id"]) for r in op10_decontam.find(docs, bench).collect()}
    assert got == {(k, i) for k in (1, 2, 6, None) for i in (10, 11)} | {(8, 14)}
    assert sorted(r["doc_id"] or 0 for r in op10_decontam.clean(docs, bench).collect()) == [0, 3, 4, 5, 7]
    assert op10_decontam.find(docs, bench.filter("item_id < 0")).count() == 0


def test_decontamination_catches_exact_passages(spark, docs):
    """Every document that holds a whole test item is found, on the driver's table."""
    from .conftest import SF

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], " ".join(words(r["text"]))) for r in bench.collect()]
    want = {(d["doc_id"], k) for d in docs for k, t in items if f" {t} " in f" {' '.join(words(d['text']))} "}
    got = {(r["doc_id"], r["item_id"]) for r in op10_decontam.find(spark.read.parquet(f"{SF}/documents.parquet"), bench).collect()}
    assert want and want <= got


def test_stages_decide_by_row(spark):
    """Rows that repeat an id, or have none, are kept or dropped each by its own text."""
    other, third = (" ".join(f"{c}{i}" for i in range(80)) for c in "pq")
    rows = [(1, BASE), (2, BASE), (2, other), (3, third), (3, third), (None, BASE), (None, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = op8_ngram_join.keep_one(frame, shingle=5, percent=80)
    assert got.columns == frame.columns
    assert rows_of(got, "doc_id", "text") == sorted([(1, BASE), (2, other), (3, third), (None, ""), (None, None)], key=repr)
    bench = spark.createDataFrame([(10, BASE)], "item_id long, text string")
    got = op10_decontam.clean(frame.filter("doc_id is not null"), bench)
    assert got.columns == frame.columns
    assert rows_of(got, "doc_id", "text") == sorted([(2, other), (3, third), (3, third)], key=repr)


OPS = {"op1": op1_quality.measure, "op2": op2_mix.mix, "op3": lambda d: op3_tokens.read(op3_tokens.write(d, TOKENIZER)),
       "op4": op4_interpolation.score, "op5": op5_secrets.scan, "op6": op6_repeats.dedup, "op7": op7_lines.dedup,
       "op8": op8_ngram_join.link, "op9": lambda d: op9_licenses.scan(d, F.concat_ws("/", "source", F.col("doc_id").cast("string")))}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(name, none):
    assert OPS[name](none).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_null_ids_and_sources(name, null_ids):
    got = OPS[name](null_ids).collect()
    assert len(got) == null_ids.count() and all(r["doc_id"] is None for r in got)


def test_words_by_regex(docs):
    texts = [t for _, t in EDGE] + [d["text"] for d in docs[:50]]
    w = tn.tokenize(*tn.flat(pa.array(texts, pa.string())))
    assert w.counts().tolist() == [len(words(t)) for t in texts]
