"""Connected components of a link table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written


def _least(edges: DataFrame) -> DataFrame:
    """``(a, m)``: the least ``b`` of each ``a``, as a written table.

    It is read back so that the join with it has plain exchanges on both sides, whose skewed partitions (a hub's links)
    adaptive execution splits.
    """
    return written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node of its neighbourhood. Needs a > b in every edge."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = _least(edges.select("a", "b").unionByName(turned))
    return turned.join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Needs a > b in every edge."""
    least = _least(edges)
    lower = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``, the component being its smallest node.

    Only nodes that have a link to another node appear. Self links, repeated links and nulls are ignored; an empty
    table gives an empty result. Each round is two pre-aggregated minimum steps over the links; a hub's links are
    split by skew-join handling since no step gathers a neighbourhood. Every step is a written table, so a lost
    executor repeats one step at most. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    before = _fingerprint(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        edges = written(_small_star(written(_large_star(edges), "links")), "links")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum of the edge set, one aggregate row."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
