"""Connected components of a table of links by alternating stars, with hubs dealt over sub-keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.session import cut_lineage

#: Links of a node that one task takes.
HUB = 100_000


def _with_least(links: DataFrame, hub: int, most: int) -> DataFrame:
    """Links (u, v) with `least`, the smallest v of their u.

    The smallest combines map-side. A node of more than `hub` links is a hub: its links are dealt
    by their other end over as many sub-keys as it has parts, and its one row is copied to each.
    With no more than `hub` links in all, `most` of them, there is none.
    """
    stats = links.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("_n"))
    if most <= hub:
        return links.join(stats.drop("_n"), "u")
    stats = cut_lineage(stats, "stars")
    parts = F.ceil(F.col("_n") / hub)
    hubs = stats.where(F.col("_n") > hub).select(F.col("u"), parts.alias("_parts"))
    # there is one hub to `hub` links at most; what is small enough is sent to every task by its size
    dealt = links.join(cut_lineage(hubs, "hubs"), "u", "left")
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("v"), F.col("_parts"))).otherwise(F.lit(0))
    copied = stats.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_n")
    return dealt.withColumn("_part", part.cast("long")).drop("_parts").join(copied, ["u", "_part"]).drop("_part")


def components(links: DataFrame, a: str = "a", b: str = "b", hub: int = HUB) -> DataFrame:
    """(node, root): the least node of each linked node's component.

    A large star links every larger neighbour of a node to the least of the node and its
    neighbours, a small star links a node and its smaller neighbours to the least of them; both
    keep what is connected connected and never make a link more. Rounds end when the links are the
    same as before, each node then hanging on its component's least. Every round is written.
    """
    node, other = F.col(a), F.col(b)
    pairs = links.where(node.isNotNull() & other.isNotNull() & (node != other))
    # the larger end first
    now = cut_lineage(pairs.select(F.greatest(node, other).alias("u"), F.least(node, other).alias("v")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, hub, 2 * mark[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        large = cut_lineage(large.distinct(), "links")
        small = _with_least(large, hub, mark[0])
        own = small.select("u", F.col("least").alias("v"))
        others = small.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = cut_lineage(own.unionByName(others).distinct(), "links")
