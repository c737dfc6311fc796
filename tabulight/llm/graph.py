"""Connected components of any number of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulight.llm.storage import kept


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for the nodes of ``links`` (columns ``a``, ``b``, equal types): root is the component's smallest node.

    Each round hangs every larger neighbour of a node under the node's smallest neighbour, and then every smaller one
    (large star, small star), until nothing changes: about the logarithm of the longest chain. Only grouped minima and
    joins against one row per node are shuffled, so a node with very many links is no hot spot: minima are merged before the
    shuffle, and Spark can split the other side of the join. Rounds are kept in the shared folder. Links to oneself
    and links with a null are left out; nodes without any other link have no row.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        # Large star: neighbours above a node go to its smallest neighbour (or itself).
        edges_up = edges.select(F.col("u").alias("v"), F.col("v").alias("other")).join(low, "v").select(F.col("other").alias("v"), F.col("m").alias("u"))
        large = edges_up.where("v <> u").distinct()
        # Small star: the node and its neighbours below it go to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        )
        edges = kept(small)
        before, state = state, _state(edges)
        if state == before:
            break
    star = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the links."""
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, u))"), F.expr("sum(cast(pmod(xxhash64(u, v), 1000003) as bigint))")).first()
    return tuple(row)
