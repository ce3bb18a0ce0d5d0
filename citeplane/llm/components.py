"""Connected components of a distributed link table, by alternating star contraction.

Each round joins and aggregates by key only: a hub's links stay rows, so the shuffle can split and pre-aggregate them,
and no group is ever gathered in one task or on the driver. Every round is written to the shared folder, which ends
its lineage. Large-star and small-star rounds follow Kiveris et al., "Connected Components in MapReduce and Beyond".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    # Written first, so that the join meets plain exchanges and can split the links of a hub.
    return both.where("b > a").join(materialize(least), F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m"))
    near = down.join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").where("a <> b")
    return near.unionByName(least.select(F.col("m").alias("a"), F.col("k").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) with a link to another: root is the least node reachable.

    Links may repeat, point either way and be empty; a link of a node to itself is ignored.
    """
    now = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        now = materialize(_small_star(_large_star(now)).distinct())
        # Contraction ends when the link set stays as it is; count and sum of hashes tell sets of links apart.
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
