"""Licence scan: TF-IDF cosine of text lines and windows to licence statements, then inheritance by path.

A template is a licence with its telling statements.  The weight of a term is its tf times its
idf, by the documents of the whole corpus that hold it.  Scored are lines, and windows of as many
terms as a statement has, over line breaks, so text around a statement does not lower its score.
Either can only reach the threshold if it holds one of a statement's key terms: the fewest
high-weight terms without which the rest of the statement is too light.  A window also needs
statement terms of enough weight, as its cosine is at most the length of the statement's part that
it holds.  All others are left out, which loses nothing.

A document's own licence is the best line or window that reaches the threshold.  A licence file gives its
directory a licence; a document without one of its own takes that of its nearest ancestor
directory, by a join of the distinct directories' ancestors.

DataFrame functions only.  Defined results: null or empty texts have no own licence but may
inherit; ties go to the licence first by name, and among a directory's files to the best score,
then the first path; repeated rows each report; a null path has no directory; the directory of a path without a
slash is the root, an ancestor of all others.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage

#: fixed values: licence ids and statements as their texts and headers word them
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
                     "Released under the BSD License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright", "Released under CC0 1.0 into the public domain"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "either version 3 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
MIN_COSINE = 0.6
#: a short document with a statement stands for a licence file where paths do not tell
FILE_WORDS = 100
TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def statements() -> list[tuple[str, int, dict[str, int]]]:
    """(licence, number, term counts) of every statement."""
    out = []
    for name, lines in TEMPLATES.items():
        for line in lines:
            tf: dict[str, int] = {}
            for t in re.findall(TERM, line.lower()):
                tf[t] = tf.get(t, 0) + 1
            out.append((name, len(out), tf))
    return out


def document_frequencies(docs: DataFrame, text: Column) -> DataFrame:
    """(term, df): the documents that hold each term."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_weights(docs: DataFrame, text: Column, seen: DataFrame | None = None) -> tuple[dict[str, float], float]:
    """idf of the template terms over all documents, and that of an unseen term."""
    vocab = sorted({t for _, _, tf in statements() for t in tf})
    seen = document_frequencies(docs, text) if seen is None else seen
    df = {r["term"]: r["df"] for r in seen.filter(F.col("term").isin(vocab)).collect()}
    n = docs.count()
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocab}, math.log(1 + n) + 1


def _keys_of(tf: dict[str, int], idf: dict[str, float], min_cosine: float) -> set[str]:
    keys: set[str] = set()
    rest = sum((c * idf[t]) ** 2 for t, c in tf.items())
    bound = min_cosine ** 2 * rest
    for t, c in sorted(tf.items(), key=lambda x: (-x[1] * idf[x[0]], x[0])):
        if rest < bound:
            break
        keys.add(t)
        rest -= (c * idf[t]) ** 2
    return keys


def key_terms(idf: dict[str, float], min_cosine: float) -> set[str]:
    return set().union(*(_keys_of(tf, idf, min_cosine) for _, _, tf in statements()))


def windows(terms: Column, idf: dict[str, float], min_cosine: float) -> Column:
    """(begin, size) of the windows of the array ``terms`` that may reach the threshold of a statement
    of ``size`` terms; a shorter text is one window."""
    said = []
    for _, _, tf in statements():
        norm = sum((c * idf[t]) ** 2 for t, c in tf.items())
        said.append(F.struct(
            F.lit(sum(tf.values())).alias("size"), F.array(*map(F.lit, sorted(_keys_of(tf, idf, min_cosine)))).alias("keys"),
            F.array(*map(F.lit, tf)).alias("terms"),
            F.create_map(*(F.lit(x) for t, c in tf.items() for x in (t, (c * idf[t]) ** 2 / norm))).alias("part")))

    def heavy(s: Column, begin: Column, size: Column) -> Column:
        held = F.array_intersect(s["terms"], F.slice(terms, begin, size))
        return F.aggregate(held, F.lit(0.0), lambda acc, t: acc + F.element_at(s["part"], t)) >= min_cosine ** 2 - 1e-6

    def around(s: Column, hit: Column) -> Column:
        first, last = F.greatest(hit - s["size"] + 1, F.lit(1)), F.least(hit, F.greatest(F.size(terms) - s["size"] + 1, F.lit(1)))
        begins = F.filter(F.sequence(F.least(first, last), last), lambda b: heavy(s, b, s["size"]))
        found = F.transform(begins, lambda b: F.struct(b.alias("begin"), s["size"].alias("size")))
        return F.when(F.array_contains(s["keys"], F.element_at(terms, hit)) & heavy(s, first, 2 * s["size"]), found)

    hits = F.filter(F.sequence(F.lit(1), F.size(terms)), lambda k: F.element_at(terms, k).isin(sorted(key_terms(idf, min_cosine))))
    found = F.transform(hits, lambda h: F.flatten(F.filter(
        F.transform(F.array(*said), lambda s: around(s, h)), lambda x: x.isNotNull())))
    return F.array_distinct(F.flatten(found))


def own_licence(rows: DataFrame, seen: DataFrame, n_docs: int, idf: dict[str, float], min_cosine: float) -> DataFrame:
    """(rid, licence, score) of the best unit; ``rows`` has rid and the candidate ``units``: the
    terms of a line, or of a window and the size of its statement."""
    spark = rows.sparkSession
    weighted = []
    for name, k, tf in statements():
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items()))
        weighted += [(t, name, k, sum(tf.values()), c * idf[t] / norm) for t, c in tf.items()]
    table = spark.createDataFrame(weighted, "term string, licence string, statement int, of int, unit double")
    counted = (rows.select("rid", F.posexplode("units").alias("line", "u"))
               .select("rid", "line", F.col("u.size").alias("size"), F.explode("u.terms").alias("term"))
               .groupBy("rid", "line", "size", "term").agg(F.count(F.lit(1)).alias("tf")))
    idf_of = F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1
    terms = stage(counted.join(seen, "term").select("rid", "line", "size", "term", (F.col("tf") * idf_of).alias("w")), "licence-terms")
    norm = terms.groupBy("rid", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = terms.join(table, "term").filter("size is null or size = of") \
        .groupBy("rid", "line", "licence", "statement").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dot.join(norm, ["rid", "line"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("score") >= min_cosine)
    best = scored.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("rid", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def inherited(dirs: DataFrame, given: DataFrame) -> DataFrame:
    """(dir, licence, from_dir) of the nearest ancestor-or-self of each directory in ``given``."""
    part = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(part))).alias("depth")) \
        .withColumn("from_dir", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    near = up.join(given, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "licence", "from_dir")).alias("b"))
    return near.select("dir", F.col("b.licence").alias("licence"), F.col("b.from_dir").alias("from_dir"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text",
         min_cosine: float = MIN_COSINE, short_files: bool = False) -> DataFrame:
    """One row per document: own licence and score, the licence that holds, and where it is from (a directory; the root is
    empty).  ``short_files``: the paths are made up and tell no file names, so a document of under ``FILE_WORDS`` words
    with a statement stands for a licence file too."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("_text"))
    seen = stage(document_frequencies(base, text), "licence-frequencies")
    idf, _ = term_weights(base, text, seen)
    keys = key_terms(idf, min_cosine)
    cue = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(map(re.escape, keys))) + r")(?![a-z0-9])"
    lines = F.when(text.rlike(cue), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(cue)))
    few = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) < FILE_WORDS
    rows = stage(base.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "path",
        F.regexp_replace("path", "(^|/)[^/]*$", "").alias("dir"),
        (F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE) | (F.lit(short_files) & F.coalesce(few, F.lit(True)))).alias("is_file"),
        lines.alias("lines"), F.when(text.rlike(cue), F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("terms"))
        .withColumn("spans", F.when(F.col("terms").isNotNull(), windows(F.col("terms"), idf, min_cosine)))
        .withColumn("units", F.concat(
            F.transform("lines", lambda x: F.struct(F.lit(None).cast("int").alias("size"), F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0)).alias("terms"))),
            F.transform("spans", lambda x: F.struct(x["size"].alias("size"), F.slice("terms", x["begin"], x["size"]).alias("terms")))))
        .drop("lines", "terms", "spans"), "licence-rows")
    own = stage(own_licence(rows.filter("units is not null"), seen, rows.count(), idf, min_cosine), "licence-own")
    full = rows.drop("units").join(own, "rid", "left")
    given = full.filter("is_file and licence is not null and dir is not null").groupBy(F.col("dir").alias("from_dir")) \
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("b")).select("from_dir", F.col("b.licence").alias("licence"))
    near = stage(inherited(rows.filter("dir is not null").select("dir").distinct(), given), "licence-dirs")
    near = near.withColumnRenamed("licence", "dir_licence")
    return full.join(near, "dir", "left").select(
        "doc_id", "path", F.col("licence").alias("own_licence"), "score",
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), F.lit("own")).when(F.col("dir_licence").isNotNull(), F.col("from_dir")).alias("from_dir"))
