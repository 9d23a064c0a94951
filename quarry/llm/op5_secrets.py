"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for the patterns below.  Positions come from two arrays that Spark's
regex functions give for the same pattern: the matches, and the pieces between them; running
sums of their lengths are the spans.  Candidate values travel as SHA-256 only.

Ownership: per value, the distinct repositories and owners over the whole corpus, aggregated
value-owner-repository first, so a value that sits in a third of all rows shrinks before any
shuffle by value.  Each span gets a label: ``copied`` if ``COPIED_OWNERS`` owners or ``COPIED_REPOS`` repositories or more hold its
value (a widely copied example, also inside one owner's forks), ``placeholder`` if the value itself says so (few different
characters, or a word such as "example"), else ``live``: owner-specific.  Base kinds are always reported; the added kinds only
where the value is live, since samples and test vectors are what makes such patterns noisy.

Defined results: a null or empty text has no spans; null owners count as one owner; repeated
rows are scanned each; overlapping kinds are each reported.  Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage

#: fixed values: kind, pattern, group of the value; the first three are the base kinds
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
    ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,})", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0),
]
BASE = 3
ASSIGN_MIN = 6
COPIED_OWNERS, COPIED_REPOS = 3, 4
#: fixed values: what marks a value as a placeholder
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your[_-]|x{4,}|[.]{3}"
MIN_CHARACTERS = 5


def placeholder(value: Column) -> Column:
    return value.rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split(value, ""))) < MIN_CHARACTERS)


def _found(text: Column, pattern: str, group: int) -> Column:
    """Array of (gap before, length, value length, value hash, placeholder), one per match."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), match.alias("m"), value.alias("v"))
    rows = F.transform(zipped, lambda z: F.struct(
        F.length(z["p"]).alias("gap"), F.length(z["m"]).alias("len"), F.length(z["v"]).alias("vlen"),
        F.sha2(z["v"], 256).alias("value"), placeholder(z["v"]).alias("fake")))
    # the last piece has no match after it
    return F.when(text.rlike(pattern), F.slice(rows, 1, F.size(match)))


def candidates(rows: DataFrame) -> DataFrame:
    """(rid, kind number, start, end, value, fake, owner, repo) of every match; end is exclusive."""
    each = None
    for k, (name, _, _) in enumerate(KINDS):
        part = rows.filter(F.col(name).isNotNull()).select(
            "rid", "owner", "repo", F.lit(k).alias("kind"), F.posexplode(name).alias("i", "m"))
        each = part if each is None else each.unionByName(part)
    w = Window.partitionBy("rid", "kind").orderBy("i")
    upto = F.sum(F.col("m.gap") + F.col("m.len")).over(w)
    return (each.withColumn("end", upto).withColumn("start", F.col("end") - F.col("m.len"))
            .filter((F.col("kind") != 0) | (F.col("m.vlen") >= ASSIGN_MIN))
            .select("rid", "kind", "start", "end", F.col("m.value").alias("value"), F.col("m.fake").alias("fake"), "owner", "repo"))


def ownership(cands: DataFrame) -> DataFrame:
    """Per value: distinct owners and repositories that hold it, and its occurrences."""
    one = cands.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    per = one.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return per.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"),
                                    F.sum("n").alias("n_seen"))


def _joined(spans: Column, last: int) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    part = F.transform(F.filter(spans, lambda s: s["kind"] < last), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(part, ",")


def labelled(cands: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """``cands`` with ``label``.  Only the copied values are joined back, one row each; Spark may split a value's rows."""
    copied = ownership(cands).filter((F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)) \
        .select("value", F.lit(True).alias("copied"))
    label = F.when(F.col("copied"), "copied").when(F.col("fake"), "placeholder").otherwise("live")
    return cands.join(copied, "value", "left").withColumn("label", label)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
         repo: Column | None = None, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per document: base counts and digest, all spans, their labels, and how many look live."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.col(text_col).alias("_text"))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo",
                             *[_found(text, p, g).alias(k) for k, p, g in KINDS]), "secret-rows")
    cands = stage(candidates(rows), "secret-candidates")
    kept = labelled(cands, copied_owners, copied_repos).filter((F.col("kind") < BASE) | (F.col("label") == "live"))
    spans = kept.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "label"))).alias("spans"),
        F.count_if(F.col("label") == "live").alias("n_live"))
    out = rows.select("rid", "doc_id").join(spans, "rid", "left")

    def count(kind: int) -> Column:
        return F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    listed = F.coalesce(_joined(F.col("spans"), len(KINDS)), F.lit(""))
    return out.select(
        "doc_id", *[F.when(F.col("spans").isNull(), F.lit(0)).otherwise(count(k)).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(F.coalesce(_joined(F.col("spans"), BASE), F.lit("")), 256).alias("base_sha256"), listed.alias("spans"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: s["label"]), ","), F.lit("")).alias("labels"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"))
