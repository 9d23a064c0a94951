"""Cases that earlier forms of the operators got wrong."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import op1_quality, op2_mix, op5_secrets, op7_lines, op8_ngram_join, op9_licenses, op10_decontam, packs
from quarry.llm.staging import free

from . import brute
from .conftest import BASE, SF, rows_of, words


def test_equal_rows_are_mixed_one_by_one(spark):
    """2,000 equal rows: so many are taken as the target needs, and reruns agree."""
    rows = [(1, "seven words that are all the same", "a")] * 2000 + [(k, f"other words number {k}", "b") for k in range(2, 1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = op2_mix.mix(frame).collect()
    for s in ("a", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1e-6
    again = op2_mix.mix(frame.repartition(3))
    assert rows_of(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)
    out = op2_mix.apply_mix(frame)
    assert out.filter("source = 'a'").count() * 7 == sum(r["taken"] for r in got if r["source"] == "a")


def test_mix_meets_targets_on_edge_rows(edge):
    got = op2_mix.mix(edge).collect()
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1e-6


def test_users_columns_keep_their_values(spark, edge):
    """Columns named like inner ones come back as they were."""
    own = {"_row_id": "keepme", "_Row_ID_": "too", "_mix_id": "a", "_copies": "b", "_copy": "c", "component_id": "d", "r": "e"}
    rows = [(k, f"{BASE} {k}", "s") for k in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(v) for c, v in own.items()})
    bench = spark.createDataFrame([(1, "never seen item text")], "item_id long, text string")
    for out in (op8_ngram_join.keep_one(frame, shingle=5, percent=80), op10_decontam.clean(frame, bench), op2_mix.apply_mix(frame)):
        assert out.columns == frame.columns and out.count() > 0
        assert out.select(*own).distinct().collect() == [tuple(own.values())]
    assert free(frame, "_row_id") == "_row_id__"


def test_decontamination_reports_rows_and_null_ids(spark):
    item, other = "the quick brown fox jumps over one lazy dog today", "a wholly different test item with words of its own"
    text = f"{BASE} {item} {BASE}"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (None, text), (6, BASE), (7, f"{other} {BASE}")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (-1, other), (9, item), (9, item)], "item_id long, text string")
    found = op10_decontam.find(docs, bench)
    want = [(d, i) for d in (5, 5, None, None) for i in (None, 9, 9)] + [(7, -1)]
    assert rows_of(found, "doc_id", "item_id") == sorted(want, key=repr)
    assert {r["score"] for r in found.collect()} == {1.0}
    assert rows_of(op10_decontam.clean(docs, bench, keep_null_ids=False), "doc_id") == [(6,)]
    assert rows_of(op10_decontam.clean(docs, bench), "doc_id") == [(6,), (None,), (None,)]


def test_decontamination_recall_on_edited_copies(spark):
    """Of the pairs that full Smith-Waterman alignment over whole texts finds, at least nine in ten are found."""
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(600)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(12, 40))] for _ in range(25)]
    docs = []
    for k in range(160):
        body = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        if k % 4:
            piece, rate = list(items[rng.randrange(25)]), rng.choice([0.0, 0.05, 0.1, 0.15, 0.2, 0.3])
            for at in range(len(piece) - 1, -1, -1):
                if rng.random() < rate:
                    piece[at:at + 1] = rng.choice([[], [rng.choice(vocab)], [piece[at], rng.choice(vocab)]])
            at = rng.randrange(len(body))
            body[at:at] = piece
        docs.append((k, " ".join(body)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    want = {(k, n) for k, t in docs for n, i in enumerate(items) if brute.align(i, words(t)) >= op10_decontam.MIN_SCORE * 2 * len(i)}
    got = {(r["doc_id"], r["item_id"]) for r in op10_decontam.find(table, bench).collect()}
    assert got <= want and len(want) > 80 and len(got & want) >= 0.9 * len(want)


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"


def test_licence_of_the_root_and_of_short_files(spark):
    rows = [("LICENSE", MIT), ("main.py", "print one"), ("src/a.py", "print two"), ("src/deep/b.py", "x"), (None, "no path")]
    got = dict(rows_of(op9_licenses.scan(spark.createDataFrame(rows, "path string, text string").withColumn("doc_id", F.lit(1)), F.col("path")),
                       "path", "licence"))
    assert got == {"LICENSE": "MIT", "main.py": "MIT", "src/a.py": "MIT", "src/deep/b.py": "MIT", None: None}
    rows = [("lib/v.js", MIT), ("lib/own.js", "var x"), ("/LICENSE.txt", "Licensed under CC BY 4.0"), ("/lib/z.js", "var y")]
    frame = spark.createDataFrame(rows, "path string, text string").withColumn("doc_id", F.lit(1))
    got = dict(rows_of(op9_licenses.scan(frame, F.col("path")), "path", "licence"))
    assert got["lib/v.js"] == "MIT" and got["lib/own.js"] != "MIT" and got["/lib/z.js"] == "CC-BY-4.0"


def test_spans_are_labelled_by_owners_repositories_and_value(spark):
    live, forked, wide = "a8Fj2kLq9Zx1", "b7Gh3mNr8Yw2", "c6Hi4oPs7Xv3"
    rows = [(1, live, "o1", "r1"), (2, "your_password_1", "o1", "r1"), (3, "xxxxxxxx", "o1", "r2")]
    rows += [(10 + k, forked, "o1", f"f{k}") for k in range(4)] + [(20 + k, wide, f"o{k}", "r") for k in range(3)]
    frame = spark.createDataFrame([(k, f"password = {v}", o, r) for k, v, o, r in rows], "doc_id long, text string, source string, lang string")
    got = dict(rows_of(op5_secrets.scan(frame), "doc_id", "labels"))
    assert got[1] == "live" and got[2] == got[3] == "placeholder"
    assert {got[10 + k] for k in range(4)} == {got[20 + k] for k in range(3)} == {"copied"}
    assert dict(rows_of(op5_secrets.scan(frame), "doc_id", "n_live"))[1] == 1


def test_quality_limits_act_and_spare_good_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    limits = op1_quality.fit_limits(docs, labels)
    assert set(limits) == {"dup_line_share", *op1_quality.SHARES}
    assert all(limits[c] >= low for c, low in zip(op1_quality.SHARES, op1_quality.PUBLISHED.values()))
    passage = " ".join(f"p{k}" for k in range(12))
    plain = " ".join(f"w{k}" for k in range(60))
    texts = [(1, f"{plain} {passage} {plain.replace('w', 'x')}"), (2, f"{plain} {passage} {passage} {passage}")]
    got = {r["doc_id"]: r for r in op1_quality.measure(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and not got[2]["base_failed"] and not got[2]["kept"]


@pytest.mark.parametrize("name", ["find", "scan", "mix", "measure"])
def test_very_long_texts(spark, name):
    text = " ".join(f"w{k % 5000}" for k in range(120_000)) + f" {BASE} password = Qm7xT2vLp9 {MIT}"
    frame = spark.createDataFrame([(1, text, "s", "l"), (2, BASE, "s", "l")], "doc_id long, text string, source string, lang string")
    if name == "find":
        got = op10_decontam.find(frame, spark.createDataFrame([(3, MIT)], "item_id long, text string"))
        assert rows_of(got, "doc_id", "item_id") == [(1, 3)]
    elif name == "scan":
        assert dict(rows_of(op5_secrets.scan(frame), "doc_id", "n_live"))[1] == 1
        assert dict(rows_of(op9_licenses.scan(frame, F.lit(None).cast("string")), "doc_id", "licence"))[1] == "MIT"
    elif name == "mix":
        assert dict(rows_of(op2_mix.mix(frame), "doc_id", "size"))[1] == len(text.split())
    else:
        assert dict(rows_of(op1_quality.measure(frame), "doc_id", "n_words"))[1] == len(text.split())


def test_rows_of_the_exchange_grow_with_the_text(spark, monkeypatch):
    """Sixteen times the text makes about sixteen times the rows of ``ask``, and not 256 times."""
    for name, size in (("BLOCK_BYTES", 1 << 10), ("BUCKET_BYTES", 1 << 11), ("ROW_BYTES", 1 << 7)):
        monkeypatch.setattr(packs, name, size)
    monkeypatch.setattr(packs.tn.chunks, "__defaults__", (1 << 9,))
    rng = random.Random(5)
    rows = {}
    for n in (200, 3200):
        texts = [(k, " ".join(f"w{rng.randrange(200_000)}" for _ in range(60))) for k in range(n)]
        held = packs.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), "t")
        bits = packs.bucket_bits(held)
        rows[n] = packs.ask(held, bits, op7_lines._ask_words(bits)).count()
    assert rows[200] > 100 and rows[3200] <= 24 * rows[200]
    block, bucket = packs.sizes(10 ** 14)
    assert (block, bucket) == (packs.MAX_BLOCK_BYTES, packs.MAX_BUCKET_BYTES)
