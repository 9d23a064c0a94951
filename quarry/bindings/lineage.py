"""Bindings for lineage (L1-L5): graphs derived from the dimension tables.

Edges: region -> nation (nation table), nation -> market segment (customers),
segment -> order priority (orders x customers); ``all_edges`` adds priority -> region
(orders x customers x nations x regions), which closes cycles.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lineage as L
from . import Registry
from .derived import PIPELINES_SQL, pipelines

REG = Registry()


def dag_edges(t):
    n, r, c, o = t.nation, t.region, t.customer, t.orders
    e1 = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lower("r_name").alias("src"), F.lower("n_name").alias("dst"))
    e2 = c.join(n, c.c_nationkey == n.n_nationkey).select(F.lower("n_name").alias("src"), F.lower("c_mktsegment").alias("dst"))
    e3 = o.join(c, o.o_custkey == c.c_custkey).select(F.lower("c_mktsegment").alias("src"), F.lower("o_orderpriority").alias("dst"))
    return e1.unionByName(e2).unionByName(e3).distinct()


def all_edges(t):
    o, c, n, r = t.orders, t.customer, t.nation, t.region
    e4 = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
          .select(F.lower("o_orderpriority").alias("src"), F.lower("r_name").alias("dst")))
    return dag_edges(t).unionByName(e4).distinct()


DAG_EDGES_SQL = """
e AS (SELECT DISTINCT lower(r_name) AS src, lower(n_name) AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION SELECT DISTINCT lower(n_name), lower(c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION SELECT DISTINCT lower(c_mktsegment), lower(o_orderpriority) FROM orders JOIN customer ON o_custkey = c_custkey)
"""
ALL_EDGES_SQL = DAG_EDGES_SQL.rstrip().rstrip(")") + """
      UNION SELECT DISTINCT lower(o_orderpriority), lower(r_name) FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@REG.query("l1_edges_from_tags", oracle="WITH p AS (" + PIPELINES_SQL + """)
SELECT DISTINCT lower(substr(s.t, 8)) AS src, lower(substr(d.t, 8)) AS dst
FROM (SELECT dag_id, unnest(tags) AS t FROM p) s JOIN (SELECT dag_id, unnest(tags) AS t FROM p) d ON s.dag_id = d.dag_id
WHERE starts_with(s.t, 'source:') AND starts_with(d.t, 'output:')
""")
def _l1(t):
    """L1: edges from pipeline tags (source: -> output:), lower-cased."""
    return L.edges_from_tags(pipelines(t))


@REG.query("l2_reach_downstream", oracle="WITH RECURSIVE " + ALL_EDGES_SQL + """,
w(name, depth) AS (SELECT 'africa', 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.name WHERE w.depth < 8)
SELECT name, min(depth) AS depth, 'downstream' AS direction FROM w WHERE name <> 'africa' GROUP BY name
""")
def _l2(t):
    """L2: nodes downstream of a region, shortest depth, cycle-safe, depth <= 8."""
    return L.reach(all_edges(t), "africa", "downstream", 8)


@REG.query("l2_reach_upstream", oracle="WITH RECURSIVE " + ALL_EDGES_SQL + """,
w(name, depth) AS (SELECT 'machinery', 0 UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.name WHERE w.depth < 8)
SELECT name, min(depth) AS depth, 'upstream' AS direction FROM w WHERE name <> 'machinery' GROUP BY name
""")
def _l2u(t):
    """L2: nodes upstream of a market segment."""
    return L.reach(all_edges(t), "machinery", "upstream", 8)


def column_edges(t):
    """Column edges between ``layer.table`` names, each written by a job named after its target
    and the first letter of its source."""
    e = dag_edges(t).select(F.concat(F.lit("gold."), "src").alias("src_dataset"), F.concat(F.lit("gold."), "dst").alias("dst_dataset"),
                            F.concat(F.lit("load "), "dst", F.lit(" "), F.substring("src", 1, 1)).alias("job"))
    pairs = F.array(F.struct(F.lit("key").alias("s"), F.lit("key").alias("d")),
                    F.struct(F.lit("name").alias("s"), F.lit("parent.name").alias("d")),
                    F.struct(F.lit("parent.name").alias("s"), F.lit("root.name").alias("d")))
    return e.withColumn("p", F.explode(pairs)).select(
        "src_dataset", F.col("p.s").alias("src_column"), "dst_dataset", F.col("p.d").alias("dst_column"), "job")


@REG.query("l3_impact", oracle="WITH RECURSIVE " + DAG_EDGES_SQL + """,
ce AS (SELECT 'gold.' || src AS sd, c.s AS sc, 'gold.' || dst AS dd, c.d AS dc, 'load ' || dst || ' ' || substr(src, 1, 1) AS job
       FROM e, (VALUES ('key', 'key'), ('name', 'parent.name'), ('parent.name', 'root.name')) c(s, d)),
w(ds, col, depth) AS (SELECT DISTINCT sd, sc, 0 FROM ce WHERE sd = 'gold.america'
                      UNION SELECT dd, dc, depth + 1 FROM w JOIN ce ON sd = ds AND sc = col),
r AS (SELECT ds, col, min(depth) AS depth FROM w GROUP BY ALL),
j AS (SELECT dd, count(DISTINCT job) AS jobs FROM ce JOIN r a ON sd = a.ds AND sc = a.col JOIN r b ON dd = b.ds AND dc = b.col AND b.depth > 0
      GROUP BY dd)
SELECT ds AS dataset, count(*) AS columns, min(depth) AS min_depth, list_sort(list(DISTINCT col)) AS column_names, any_value(jobs) AS jobs
FROM r JOIN j ON dd = ds WHERE depth > 0 GROUP BY ds
""")
def _l3(t):
    """L3: downstream impact of a dataset over column-level edges: columns, depth and jobs."""
    return L.impact(column_edges(t), "gold.america")


@REG.query("l4_task_levels", oracle="WITH RECURSIVE " + DAG_EDGES_SQL + """,
roots AS (SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)),
p(node, lvl) AS (SELECT node, 0 FROM roots UNION SELECT e.dst, p.lvl + 1 FROM p JOIN e ON e.src = p.node)
SELECT node AS task, max(lvl) AS level FROM p GROUP BY node
""")
def _l4(t):
    """L4: longest-path level of every task of the region -> nation -> segment -> priority DAG."""
    return L.task_levels(dag_edges(t))


@REG.query("l5_declare_inputs", oracle="WITH p AS (" + PIPELINES_SQL + """),
tg AS (SELECT dag_id, unnest(tags) AS t FROM p),
e AS (SELECT DISTINCT lower(substr(s.t, 8)) AS src, lower(substr(d.t, 8)) AS dst FROM tg s JOIN tg d ON s.dag_id = d.dag_id
      WHERE starts_with(s.t, 'source:') AND starts_with(d.t, 'output:'))
SELECT src, dst FROM e
UNION SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), 'bronze/pages' FROM pages
""")
def _l5(t):
    """Declared external inputs (page hosts) added as edges into bronze/pages."""
    hosts = t.pages.select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("src"))
    return L.declare_inputs(L.edges_from_tags(pipelines(t)), hosts, "bronze/pages")


DAYS_SQL = """
d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders))
"""


def day_chain(t, ring: bool):
    """Edges from each order day to the next, from each day to its month, and (``ring``) from the last day back to the first."""
    day = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    w = Window.orderBy("day")  # one row per calendar day
    near = day.select(F.col("day"), F.lead("day").over(w).alias("next"))
    name = lambda c: F.col(c).cast("string")
    e = near.filter("next IS NOT NULL").select(name("day").alias("src"), name("next").alias("dst"))
    e = e.unionByName(day.select(name("day").alias("src"), F.date_format("day", "yyyy-MM").alias("dst")))
    if ring:
        e = e.unionByName(day.agg(F.max("day").cast("string").alias("src"), F.min("day").cast("string").alias("dst")))
    return e


@REG.query("l2_reach_deep", oracle="WITH " + DAYS_SQL + """
, s AS (SELECT k AS k0 FROM d WHERE day = (SELECT min(day) FROM d WHERE day >= DATE '1995-01-01')),
r AS (SELECT day, (k - k0 + n) % n AS depth FROM d, s)
SELECT CAST(day AS VARCHAR) AS name, CAST(depth AS INTEGER) AS depth FROM r WHERE depth > 0
UNION ALL SELECT strftime(day, '%Y-%m'), CAST(min(depth) + 1 AS INTEGER) FROM r GROUP BY 1
""")
def _l2d(t):
    """L2: a ring of all order days (some thousand hops) with a branch to each month, walked from the first day of 1995 by pointer jumping."""
    start = t.orders.filter("o_orderdate >= '1995-01-01'").agg(F.min(F.to_date("o_orderdate")).cast("string")).first()[0]
    return L.reach(day_chain(t, True), start).select("name", "depth")


@REG.query("l4_levels_deep", oracle="WITH " + DAYS_SQL + """
SELECT CAST(day AS VARCHAR) AS task, CAST(k - 1 AS INTEGER) AS level FROM d
UNION ALL SELECT strftime(day, '%Y-%m'), CAST(max(k) AS INTEGER) FROM d GROUP BY 1
""")
def _l4d(t):
    """L4: levels of a chain of all order days, each month one level after its last day."""
    return L.task_levels(day_chain(t, False))
