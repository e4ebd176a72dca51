"""Connected groups of a graph whose links are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage, sized


def connected(links: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """``node`` and ``root``, the least node reachable, for every node that has a link to another one.

    Large and small stars in turn: every link is moved to the least neighbour until all links of a group point at its
    least node. A group's work is a sum per node and a join, never a group in one task; a chain of n nodes takes about
    log n rounds. Rounds have as many tasks as the links that are left need; ``most``: how many there are at the outset,
    if that is known.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges = cut_lineage(edges if most is None else sized(edges, most))
    before, rows = None, edges.count()
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = sized(both.groupBy("x").agg(F.min("y").alias("m")), rows).select("x", F.least("x", "m").alias("m"))
        moved = sized(both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), rows)
        lowest = sized(moved.groupBy("u").agg(F.min("v").alias("m")), rows)
        others = moved.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(sized(others.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct(), rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
