"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.shared import compact, join_counted, materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that a link names; root is the component's smallest node.

    Every step is two shuffles of the links: the smallest neighbour of each node (combined on the
    map side, so that a node with many links is no single group), then a join of the links with
    it, in which nodes with many links are met by a broadcast. Links are never gathered by node;
    few links stay in few partitions.
    Null ends and self links are left out; no links give an empty table.
    """
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    before, total = None, edges.count()
    edges = compact(edges, total)
    while True:
        edges = materialise(compact(_large_star(edges, 2 * total), total))
        edges = materialise(compact(_small_star(edges, 2 * total), 2 * total))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest one of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_counted(both.where("v > u"), least, ["u"], total)
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_counted(edges, least, ["u"], total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return compact(joined.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))), 2 * total).distinct()
