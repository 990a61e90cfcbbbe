"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each linked node's component.

    Every round gives a node the least root among its own and its neighbours', then the root of
    that root; a table of nodes is written once a round. Loops until no root moves, which for
    components that hang on hubs takes two or three rounds.
    """
    both = cut_lineage(links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "links")
    roots = cut_lineage(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.min("root").alias("near"))
        met = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(met.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "roots")
        roots = moved.select("node", "root")
        if not moved.where(F.col("root") != F.col("old")).limit(1).count():
            return roots
