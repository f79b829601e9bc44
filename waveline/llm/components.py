"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.llm.common import Scratch


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = _least_neighbour(down)
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v); the root is the least node.

    Each round writes its links to the shared folder, which cuts the lineage.
    Hubs are met by a grouped minimum and a join that can be split, never by a
    list of neighbours. Links with a null end and loops are left out.
    """
    links = scratch.put(links.filter("u != v").distinct())
    seen = None
    while True:
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen or not now[0]:
            break
        seen = now
        after = scratch.put(_small_star(_large_star(links)).filter("u != v").distinct())
        scratch.drop(links)
        links = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
