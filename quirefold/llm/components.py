"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two partial aggregations and two joins; a hub's rows meet one aggregated row, so adaptive
execution can split them. Rounds are cut by written tables, and only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """links point from the larger to the smaller end."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v), both of one ordered type; root is the component's least node.

    Links may repeat, point either way or from a node to itself (then they count for nothing).
    """
    scratch = Scratch(links.sparkSession, "components")
    now = scratch.write(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = mark(now)
    while seen[0]:
        new = scratch.write(_small(_large(now)))
        scratch.drop(now)
        now, old, seen = new, seen, mark(new)
        if seen == old:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
