"""Connected components of a link table as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrid.llm.frames import store



def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long), root being the
    smallest node of its component and not listed itself.

    Alternates the large-star and the small-star step: every node hands its
    smallest neighbour to its larger, then to its smaller neighbours, until
    nothing changes (a few rounds; their number grows with the logarithm of the
    nodes).  Minima have a map-side partial aggregate and meet the links in an
    equi-join that Spark splits for a node with very many links.  Every round
    is a written table, so a lost executor costs one round at most."""
    a, b = F.col("a"), F.col("b")

    def hand_over(directed: DataFrame) -> DataFrame:
        """(node, neighbour, m): m, the smallest of the node and its neighbours."""
        smallest = directed.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        return directed.join(smallest, a == F.col("k"))

    def kept(pairs: DataFrame) -> DataFrame:
        return store(pairs.filter(a != b).distinct(), "links")

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count("a"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        now = kept(hand_over(both).filter(b > a).select(b.alias("a"), F.col("m").alias("b")))
        small = hand_over(now)
        now = kept(small.select(b.alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))))
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(a.alias("node"), b.alias("root"))
