"""Link-graph queries (JN10, GR1-GR3, TK5, SO4).

Items are orders; an order's text links (SF3) to the order numbered by its
customer key and to the next order.  Every order's text is read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textfn as tx
from ..operators import graph as gr
from ..sources.tables import Tables
from .q_scalar import INTERNAL, internal_link_texts
from .registry import register

EDGES_SQL = r"""x AS (SELECT o_orderkey AS itemId,
  'ref https://site.example/items/' || CAST(o_custkey AS VARCHAR) || '?x=1 and https://site.example/items/'
  || CAST(o_orderkey + 1 AS VARCHAR) || ' done' AS text FROM orders),
l AS (SELECT itemId AS src, CAST(unnest(regexp_extract_all(text, 'https://site\.example/items/(\d+)(?:[/?#][^\s]*)?', 1))
        AS BIGINT) AS dst FROM x),
edges AS (SELECT DISTINCT l.src, l.dst FROM l JOIN orders o ON o.o_orderkey = l.dst WHERE l.src <> l.dst)"""


def edges(t):
    src = internal_link_texts(t).withColumn("targets", tx.internal_link_ids("text", INTERNAL))
    return gr.link_edges(src, t.orders, "itemId", "targets", "o_orderkey")


@register("jn10_link_edges", f"WITH {EDGES_SQL} SELECT src, dst FROM edges")
def jn10_link_edges(spark, d):
    return edges(Tables(spark, d))


@register("gr1_degrees", f"""
WITH {EDGES_SQL}
SELECT o.o_orderkey, COALESCE(i.n, 0) AS in_degree, COALESCE(u.n, 0) AS out_degree
FROM orders o LEFT JOIN (SELECT dst, COUNT(*) AS n FROM edges GROUP BY 1) i ON o.o_orderkey = i.dst
LEFT JOIN (SELECT src, COUNT(*) AS n FROM edges GROUP BY 1) u ON o.o_orderkey = u.src
""")
def gr1_degrees(spark, d):
    t = Tables(spark, d)
    return gr.degrees(edges(t), t.orders.select("o_orderkey"), "o_orderkey").select(
        "o_orderkey", "in_degree", "out_degree")


@register("tk5_max_in_degree", f"""
WITH {EDGES_SQL}
SELECT dst AS node, COUNT(*) AS in_degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1
""")
def tk5_max_in_degree(spark, d):
    e = edges(Tables(spark, d))
    return (e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
            .orderBy(F.desc("in_degree"), "node").limit(1))


# Labels fall to the smallest neighbour's, all nodes at once, until a round moves none.
CC_SQL = f"""WITH RECURSIVE {EDGES_SQL},
u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
r(node, comp, moved) AS (
  SELECT DISTINCT src, src, true FROM u
  UNION ALL
  SELECT node, new, sum(CASE WHEN new < old THEN 1 ELSE 0 END) OVER () > 0
  FROM (SELECT r.node, any_value(r.comp) AS old, least(any_value(r.comp), min(o.comp)) AS new
        FROM r JOIN u ON u.src = r.node JOIN r o ON o.node = u.dst WHERE r.moved GROUP BY r.node)),
cc AS (SELECT node, comp AS component FROM r WHERE NOT moved)"""


@register("gr2_connected_components", f"{CC_SQL} SELECT node, component FROM cc")
def gr2_components(spark, d):
    return gr.connected_components(edges(Tables(spark, d))).select("node", "component")


@register("gr3_component_summary", f"""{CC_SQL}
SELECT c.component, c.n_nodes, COALESCE(e.n_edges, 0) AS n_edges
FROM (SELECT component, COUNT(*) AS n_nodes FROM cc GROUP BY 1) c
LEFT JOIN (SELECT cc.component, COUNT(*) AS n_edges FROM edges JOIN cc ON edges.src = cc.node GROUP BY 1) e
  USING (component)
""")
def gr3_component_summary(spark, d):
    e = edges(Tables(spark, d))
    cc = gr.connected_components(e)
    return gr.component_summary(cc, e).select("component", "n_nodes", "n_edges")


@register("so4_all_but_largest_component", f"""{CC_SQL},
s AS (SELECT component, COUNT(*) AS n FROM cc GROUP BY 1),
big AS (SELECT component FROM s ORDER BY n DESC, component LIMIT 1)
SELECT node, component FROM cc WHERE component NOT IN (SELECT component FROM big)
""")
def so4_all_but_largest(spark, d):
    cc = gr.connected_components(edges(Tables(spark, d)))
    big = (cc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component")
           .limit(1).select("component"))
    return cc.join(big, "component", "left_anti").select("node", "component")
