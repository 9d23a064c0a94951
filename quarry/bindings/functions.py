"""Bindings for the scalar helpers of SURVEY §2.9 on part / events / lineitem columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from . import Registry
from .derived import RUNS_SQL, runs

REG = Registry()


@REG.query("fn_names_and_paths", oracle="""
SELECT p_partkey,
       regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS slug,
       replace(trim('silver/' || lower(p_brand) || '/', '/'), '/', '_') AS safe_name,
       split_part(trim('/silver/' || lower(p_brand), '/'), '/', 1) AS container,
       regexp_replace(regexp_replace('silver_' || lower(replace(p_type, ' ', '_')) || '_rules', '_rules$', ''), '^([^_]*)_', '\\1/') AS dataset,
       upper(substr(lower(p_brand), 1, 1)) || substr(lower(p_brand), 2) || ' Delta Table' AS label,
       lower(trim('  ' || p_brand || '  ')) AS cleaned
FROM part
""")
def _names(t):
    """§2.9 string helpers: table slug, safe dataset name, container, table -> dataset, labels."""
    p = t.part
    return p.select(
        "p_partkey", X.table_slug("p_name").alias("slug"),
        X.safe_dataset_name(F.concat(F.lit("silver/"), F.lower("p_brand"), F.lit("/"))).alias("safe_name"),
        X.container_of(F.concat(F.lit("/silver/"), F.lower("p_brand"))).alias("container"),
        X.dataset_from_table(F.concat(F.lit("silver_"), F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("_rules")),
                             "_rules").alias("dataset"),
        X.layer_label(F.lower("p_brand")).alias("label"),
        X.clean_string(F.concat(F.lit("  "), F.col("p_brand"), F.lit("  "))).alias("cleaned"))


@REG.query("fn_runs_and_tags", oracle=f"""
WITH r AS ({RUNS_SQL})
SELECT dag_run_id,
       CASE WHEN starts_with(dag_run_id, 'backfill__') THEN 'Backfill' WHEN starts_with(dag_run_id, 'manual__') THEN 'Manual'
            ELSE 'Scheduled' END AS kind,
       CAST(strptime(regexp_extract(dag_run_id, '__(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}})', 1), '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS run_date,
       strftime(start_date, '%d_%m_%Y_%H') AS date_key,
       strptime(strftime(start_date, '%d_%m_%Y_%H'), '%d_%m_%Y_%H') AS slot_start,
       lower(substr('source:' || state, 8)) AS src_tag
FROM r
""")
def _runs(t):
    """§2.9 run-id helpers: run kind from the prefix, run date by regex, date keys, tag values."""
    r = runs(t)
    return r.select("dag_run_id", X.run_kind("dag_run_id").alias("kind"),
                    X.run_date_from_id("dag_run_id").cast("timestamp_ntz").alias("run_date"),
                    X.date_key("start_date").alias("date_key"), X.parse_date_key(X.date_key("start_date")).alias("slot_start"),
                    X.tag_value(F.concat(F.lit("source:"), F.col("state")), "source").alias("src_tag"))


@REG.query("fn_human_formats", oracle="""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice * l_quantity * 1000 AS n, l_extendedprice * 977 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN n >= 1e9 THEN format('{:,.1f}', n / 1e9) || 'B' WHEN n >= 1e6 THEN format('{:,.1f}', n / 1e6) || 'M'
            WHEN n >= 1e3 THEN format('{:,.1f}', n / 1e3) || 'K' ELSE format('{:,.0f}', n) END AS count_text,
       CASE WHEN b IS NULL OR b = 0 THEN '—' WHEN b >= 1073741824 THEN format('{:,.1f}', b / 1073741824) || ' GB'
            WHEN b >= 1048576 THEN format('{:,.1f}', b / 1048576) || ' MB' ELSE format('{:,.1f}', b / 1024) || ' KB' END AS byte_text,
       round(l_quantity * 100.0 / nullif(l_linenumber, 0), 2) AS pct
FROM v
""")
def _human(t):
    """§2.9 number formats: K/M/B counts and KB/MB/GB sizes, NULLIF-guarded percent."""
    l = t.lineitem
    return l.select("l_orderkey", "l_linenumber", "l_partkey",
                    X.human_count(F.col("l_extendedprice") * F.col("l_quantity") * 1000).alias("count_text"),
                    X.human_bytes(F.col("l_extendedprice") * 977).alias("byte_text"),
                    X.pct("l_quantity", "l_linenumber").alias("pct"))


@REG.query("fn_logs_and_months", oracle="""
SELECT event_id, regexp_extract(event_type || ' user=' || user_id || ', done', 'user=([0-9]+)', 1) AS user_text,
       date_trunc('month', ts) AS month FROM events
""")
def _logs(t):
    """§2.9: a field read from a log line by pattern, and a time truncated to its month."""
    line = F.concat(F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(", done"))
    return t.events.select("event_id", X.log_field(line, "user").alias("user_text"),
                           X.month_start("ts").cast("timestamp_ntz").alias("month"))
