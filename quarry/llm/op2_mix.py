"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

``targets`` finds the water level: source s gets ``min(cap_s, level * weight_s)`` and the
parts add up to the total.  Each round clamps the sources above their cap and shares the
excess among the rest by weight; the level only rises, so the loop ends at the exact fixed
point.  A round is one small aggregate over one row per source.

``sample`` takes every document ``floor(rate)`` times and once more for a seeded share: the
documents of a source in the order of a keyed hash, until the source's words are reached.
The cut point is found through two 256-way histograms, so no task ever holds a whole source.
Whole documents only; a source ends within half a document of its target (its last one).

Defined results: null or empty texts have size 0 and are taken 0 words; sources sort by code
point with null last; sources with no words get target 0; every row is sampled by itself, equal rows
(same id, text and source) too: at the cut so many of them are taken as the target needs; an empty table gives an empty
result.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import free, indexed, stage

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .. ``cycle``, repeating, by the code-point order of ``source``, null last."""
    order = [F.col("source").asc_nulls_last()]
    return (indexed(sources, order, "mix-order", out="rank")
            .withColumn("weight", (F.col("rank") % cycle + 1).cast("double")).drop("rank"))


def targets(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to one row per source (``source_size``, ``weight``)."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, wet = -1.0, 0.0
    while wet > level:
        level = wet
        over = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        wet = (total - row[0]) / row[1] if row[1] else level
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(max(level, 0.0)))))


def _cut(hist: DataFrame, slot: str) -> DataFrame:
    """Per source the first slot whose running size passes ``need``; ``need`` becomes the rest."""
    w = Window.partitionBy("_sid").orderBy(slot)
    run = hist.withColumn("_run", F.sum("_size").over(w))
    hit = run.filter(F.col("_run") > F.col("need"))
    return hit.groupBy("_sid").agg(F.min(F.struct(
        F.col(slot), (F.col("need") - F.col("_run") + F.col("_size")).alias("need"))).alias("_m")) \
        .select("_sid", F.col(f"_m.{slot}").alias(slot), F.col("_m.need").alias("need"))


def _planned(rows: DataFrame, weights, max_epochs: float) -> DataFrame:
    """Adds source_size, target and copies to staged rows (_rid, doc_id, source, size, _hi, _lo, _key)."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = weights(stage(per, "mix-sources"))
    src = stage(src, "mix-weights")
    src = targets(src, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + F.lit(1e-12))
    src = stage(src.select("source", F.xxhash64("source", F.col("source").isNull()).alias("_sid"),
                           "source_size", "target", whole.cast("long").alias("whole"),
                           F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("need")),
                "mix-targets")
    part = src.filter("need > 0").select("_sid", "need")
    rows = rows.withColumn("_sid", F.xxhash64("source", F.col("source").isNull()))

    # the slot of each source where its extra copies stop, then the slot inside that slot
    hi = stage(_cut(rows.groupBy("_sid", "_hi").agg(F.sum("size").alias("_size")).join(part, "_sid"), "_hi"), "mix-hi")
    in_hi = rows.join(hi, ["_sid", "_hi"])
    lo = stage(_cut(in_hi.groupBy("_sid", "_hi", "_lo").agg(F.sum("size").alias("_size"), F.first("need").alias("need")), "_lo")
               .join(hi.select("_sid", "_hi"), "_sid"), "mix-lo")
    # that last slot, about 1 in 65,536 of the source, in hash order; equal rows are one group of it, and of a group
    # so many rows are taken as end nearest to the target
    group = ["_sid", "_key", "doc_id", "size"]
    last = stage(rows.join(lo, ["_sid", "_hi", "_lo"]), "mix-last")
    groups = last.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.first("need").alias("_left"))
    w = Window.partitionBy("_sid").orderBy("_key", "doc_id", "size")
    before = F.coalesce(F.sum(F.col("size") * F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.floor((F.col("_left") - before) / F.col("size") + F.lit(0.5))
    take = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("_n"), fits))).otherwise(0).cast("long")
    groups = stage(groups.withColumn("_take", take).select(*[F.col(c).alias(f"_g{c}") for c in group], "_n", "_take"), "mix-groups")
    cond = [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in group]
    last = last.join(groups, cond).select("_rid", "_sid", "_n", "_take")
    cut_group = last.filter("_take > 0 AND _take < _n")  # one group of a source at most
    ranked = indexed(cut_group, [F.col("_sid"), F.col("_rid")], "mix-ranked", out="_at")
    start = ranked.groupBy("_sid").agg(F.min("_at").alias("_from"))
    some = ranked.join(start, "_sid").filter(F.col("_at") - F.col("_from") < F.col("_take")).select("_rid")
    picked = stage(last.filter("_take = _n").select("_rid").unionByName(some), "mix-picked").withColumn("_picked", F.lit(True))

    cut = src.select("_sid", F.col("source_size"), "target", "whole", "need") \
        .join(lo.select("_sid", F.col("_hi").alias("_chi"), F.col("_lo").alias("_clo")), "_sid", "left")
    full = rows.join(stage(cut, "mix-cut"), "_sid")
    here = F.coalesce((F.col("_hi") == F.col("_chi")) & (F.col("_lo") == F.col("_clo")), F.lit(False))
    below = F.col("_chi").isNull() | (F.col("_hi") < F.col("_chi")) | ((F.col("_hi") == F.col("_chi")) & (F.col("_lo") < F.col("_clo")))
    out = full.filter(~here).withColumn("_extra", (F.col("need") > 0) & below).unionByName(
        full.filter(here).join(picked, "_rid", "left").withColumn("_extra", F.coalesce("_picked", F.lit(False))).drop("_picked"))
    copies = F.least(F.col("whole") + F.col("_extra").cast("int"), F.lit(int(max_epochs)))
    return out.select("_rid", "_key", "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"),
                      (copies * F.col("size")).cast("long").alias("taken"))


def _key(seed: int, ident: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), ident, text)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, rid: Column) -> DataFrame:
    key = _key(seed, F.col("doc_id"), F.col("_text"))
    return stage(
        docs.select(rid.alias("_rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"))
        .select("_rid", "doc_id", "source", word_count(F.col("_text")).alias("size"),
                F.shiftrightunsigned(key, 56).cast("int").alias("_hi"),
                F.shiftrightunsigned(key, 48).bitwiseAND(255).cast("int").alias("_lo"),
                key.alias("_key")), "mix-rows")


def mix(docs: DataFrame, weights=cyclic_weights, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", max_epochs: float = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """One row per document: size, its source's size and target, and the words taken.

    ``weights`` maps one row per source to the same rows with a ``weight`` column.
    """
    rows = _sized(docs, id_col, text_col, source_col, seed, F.monotonically_increasing_id())
    return _planned(rows, weights, max_epochs).drop("_rid", "_key")


def apply_mix(docs: DataFrame, weights=cyclic_weights, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", max_epochs: float = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The mixed corpus: rows of ``docs`` (all columns), each as often as the mix takes it.

    Rows equal in id, text and source are one group of the plan, and only the groups at a source's cut have rows
    that are taken more often than others; those rows alone are staged and numbered.
    """
    rows = _sized(docs, id_col, text_col, source_col, seed, F.monotonically_increasing_id())
    group = [F.col(c).alias(n) for c, n in (("_key", "g_key"), ("doc_id", "g_id"), ("source", "g_source"))]
    plan = stage(_planned(rows, weights, max_epochs).groupBy(*group).agg(
        F.min("copies").alias("g_low"), F.max("copies").alias("g_high"), F.sum("copies").alias("g_sum"), F.count(F.lit(1)).alias("g_n"))
        .filter("g_high > 0"), "mix-plan")
    body, i = free(docs, "_row"), free(docs, "_copy")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(body))
    col = lambda c: F.col(body)[c]
    mine = (_key(seed, col(id_col), col(text_col)) == F.col("g_key")) & col(id_col).eqNullSafe(F.col("g_id")) \
        & col(source_col).eqNullSafe(F.col("g_source"))
    alike = held.join(plan.filter("g_low = g_high"), mine).select(body, F.col("g_low").alias(i))
    cut = stage(held.join(plan.filter("g_low < g_high"), mine).withColumn("g_row", F.monotonically_increasing_id()), "mix-cut-rows")
    at = indexed(cut.select("g_key", "g_id", "g_source", "g_row"), [F.col(c) for c in ("g_key", "g_id", "g_source", "g_row")], "mix-cut-order", out="g_at")
    first = at.groupBy("g_key", "g_id", "g_source").agg(F.min("g_at").alias("g_first"))
    place = at.join(first, [at[c].eqNullSafe(first[c]) for c in ("g_key", "g_id", "g_source")]).select("g_row", (F.col("g_at") - F.col("g_first")).alias("g_place"))
    more = F.col("g_place") < F.col("g_sum") - F.col("g_low") * F.col("g_n")
    uneven = cut.join(place, "g_row").select(body, (F.col("g_low") + more.cast("int")).alias(i))
    taken = alike.unionByName(uneven).filter(F.col(i) > 0)
    return taken.select(body, F.explode(F.sequence(F.lit(1), F.col(i))).alias(i)).select(f"{body}.*")
