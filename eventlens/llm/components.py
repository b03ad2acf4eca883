"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations and joins on the link table; nothing is
collected. A node with very many links is one key of a partially aggregated
minimum and of a join; the minima are stored, so the join has exchanges of its
own on both sides and the adaptive plan may split such a node's links. Rounds
are written to the shared folder, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the least of the node and its neighbours."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its neighbours below it go to the least of these neighbours."""
    low = stored(e.groupBy("a").agg(F.min("b").alias("m")), "least")
    down = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(low.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)``: the least node reachable, for every node of ``links``
    that is not a root itself. Null ends and self-links count as no link; an
    empty table gives an empty result."""
    e = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
               .where(f"`{a}` is not null and `{b}` is not null").where("a <> b").distinct(), "links")
    sign = None
    while True:
        e = stored(_small_star(stored(_large_star(e), "links")).where("a <> b").distinct(), "links")
        # count and order-free hash of the links: equal after a round without change
        now = e.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("b")).first()
        if tuple(now) == sign:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = tuple(now)
