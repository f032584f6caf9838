"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import removed, written_at


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); component is its smallest reachable node.

    Each round links every node to the smallest neighbour it knows and writes the links that are
    left to the shared folder; the number of rounds grows with the logarithm of the longest path. Smallest neighbours
    are pre-aggregated before they are shuffled. Links of a node to itself and repeated links do
    no harm; rows with a null end are left out.
    """
    edges, path = written_at(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
        # Large star: larger neighbours of a node go to its smallest one.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Small star: smaller neighbours, and the node itself, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = path
        edges, path = written_at(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        removed(links.sparkSession, old)
