"""Connected components of a link table, with shuffles only: no node list on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.session import cut_lineage


def _lower_ends(edges: DataFrame) -> DataFrame:
    """Link every node to the lowest neighbour of its lower neighbour (large star)."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("lo"), F.least("u", "v").alias("m"))
    return edges.join(least, "lo").select("hi", F.col("m").alias("lo"))


def _lower_starts(edges: DataFrame) -> DataFrame:
    """Link a node's lower neighbours, and the node, to the lowest of them (small star)."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    side = edges.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return side.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long); root is the lowest node reachable.

    Alternating star steps (Kiveris et al. 2014) until nothing changes: a number of rounds about
    the logarithm of the longest path. Minima are partial aggregates and come back by joins, which
    Spark can split where one node has very many links. Each round is a written table.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()
    edges, before = cut_lineage(edges), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        edges = cut_lineage(_lower_starts(_lower_ends(edges).distinct()))
    roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
