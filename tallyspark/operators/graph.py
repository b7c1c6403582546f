"""Link graphs as edge/node DataFrames (GR1-GR3, JN10, TK5, SO4).

Connected components: min-label propagation with pointer jumping on
DataFrames.  Each round is two joins and one aggregation; the label table is
cut from its lineage with a reliable checkpoint every few rounds; the loop
stops when a round changes no label (one small count per round reaches the
driver, nothing else).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def link_edges(sources: DataFrame, items: DataFrame, src: str, targets_col: str, item_key: str) -> DataFrame:
    """JN10: distinct (src, dst) edges whose target exists among ``items`` and is not the source."""
    e = sources.select(F.col(src).alias("src"), F.explode(targets_col).alias("dst")).where(F.col("dst").isNotNull())
    known = items.select(F.col(item_key).alias("dst")).distinct()
    return e.join(known, "dst").where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def degrees(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """GR1: in- and out-degree per node, zero-filled."""
    outd = edges.groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("out_degree"))
    ind = edges.groupBy(F.col("dst").alias(key)).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(ind, key, "left").join(outd, key, "left").fillna({"in_degree": 0, "out_degree": 0})


#: Edges of a node beyond which its join rows are not dealt by the node: there are at most (edges / HUB) such nodes.
HUB = 100_000


def _with_least(e: DataFrame, node: str, least: DataFrame, hub: int) -> DataFrame:
    """Edges with ``m``, the label of their ``node`` in ``least`` (node, m: one row a node), or the node itself without one.

    The edges of a node end in one task of a join by node, and near the end a node has all edges of its component.
    So the labels of nodes with more than ``hub`` edges are broadcast and only the other edges are dealt by node."""
    counts = e.groupBy(F.col(node).alias("__h")).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > hub).select("__h")
    hubs = counts.join(least, F.col("__h") == F.col("node"), "left").select("__h", F.coalesce("m", "__h").alias("__m"))
    known = e.join(F.broadcast(hubs), F.col(node) == F.col("__h"), "left")
    rest = known.where(F.col("__m").isNull()).select("src", "dst").join(least, F.col(node) == F.col("node"), "left")
    return (rest.select("src", "dst", F.coalesce("m", node).alias("m"))
            .unionByName(known.where(F.col("__m").isNotNull()).select("src", "dst", F.col("__m").alias("m"))))


def _least(e: DataFrame) -> DataFrame:
    """(node, m): the smallest neighbour of each node that has a smaller one; ``src`` is an edge's larger end."""
    return e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))


def _large_star(e: DataFrame, hub: int = HUB) -> DataFrame:
    """Each node's larger neighbours re-point to the node's smallest neighbour (or itself)."""
    return _with_least(e, "dst", _least(e), hub).select("src", F.col("m").alias("dst")).distinct()


def _small_star(e: DataFrame, hub: int = HUB) -> DataFrame:
    """Each node and its smaller neighbours re-point to the smallest of them."""
    m = _least(e)
    j = _with_least(e, "src", m, hub)
    out = (j.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
           .unionByName(m.select(F.col("node").alias("src"), F.col("m").alias("dst"))))
    return out.where(F.col("src") != F.col("dst")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 200, hub: int = HUB) -> DataFrame:
    """GR2: weakly connected components by alternating large-star / small-star rounds
    (O(log^2 n) rounds; each round is a few grouped minima and joins over the edge
    table, which never grows).  At the fixed point every component is a star
    around its smallest node, so ``component`` = the smallest node id in it.
    The edge table is checkpointed after every star; a round's checksum (count and
    sum of edge hashes) reaching the driver is the only collect."""
    e = edges.select(F.least("src", "dst").alias("dst"), F.greatest("src", "dst").alias("src"))
    e = cut_lineage(e.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    prev = None
    for i in range(max_rounds):
        e = cut_lineage(_small_star(cut_lineage(_large_star(e, hub)), hub))
        sig = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if sig == prev:
            break
        prev = sig
    else:
        raise RuntimeError(f"the components still change after {max_rounds} rounds")
    e.sparkSession.conf.set("tally.cc_rounds", str(i + 1))
    star = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    return nodes.join(star, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_summary(components: DataFrame, edges: DataFrame) -> DataFrame:
    """GR3: nodes and edges per component, ranked by size."""
    n = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = (edges.join(components.withColumnRenamed("node", "src"), "src")
         .groupBy("component").agg(F.count(F.lit(1)).alias("n_edges")))
    return n.join(e, "component", "left").fillna({"n_edges": 0})
