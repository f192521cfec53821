"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import dropped, written


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and two order-free sums of hashes."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(2147483647))), F.bit_xor(h)).first())


def components(links: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """One row (node, component) for each node of `links`; component is the smallest node reached.

    Null ends and links of a node to itself join nothing; a node that has only such links is left out. Only minima are
    gathered at a node, never its neighbours, so a hub needs no more memory than any other node, and its rows are
    split by adaptive execution. Each round is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b").distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before_edges, edges = edges, written(small.where("a <> b").distinct(), "edges")
        dropped(before_edges)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
