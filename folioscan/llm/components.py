"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """Nodes of `links` (a, b: bigint) with the smallest node they can reach: node, component.

    Each round hangs the larger neighbours of a node below the smallest one, then the smaller
    neighbours; the rounds end when nothing changes, after about log(nodes) of them. Links may be
    repeated, loops and links with a null end are left out. The minimum of a node is written before
    it is joined, so that both sides of the join are plain exchanges and a node with very many links
    is split by adaptive execution. Each round is a reliable checkpoint.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    edges = cut_lineage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _digest(edges)
    while seen[0]:
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(
            edges.select(F.col("v").alias("node"), F.col("u").alias("other"))
        )
        lowest = cut_lineage(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low")))
        large = cut_lineage(edges.join(lowest, edges.v == lowest.node).select("u", F.col("low").alias("v")).distinct())
        lowest = cut_lineage(large.groupBy("u").agg(F.min("v").alias("low")))
        hung = large.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut_lineage(hung.union(lowest.select("u", F.col("low").alias("v"))).distinct())
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
