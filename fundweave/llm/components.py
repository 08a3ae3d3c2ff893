"""Connected components of a link table by alternating large and small stars.

Every round replaces links by links to a smaller neighbour (two grouped minima and two
joins); after a number of rounds that grows with the logarithm of the number of nodes, each
component is a star around its least node. Every round is a written table, so no round's
loss costs more than itself, and no links come to the driver. A node with a large part of
all links, such as the centre of a large star, has its least neighbour broadcast, so that
its links are not dealt to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import join_unique, staged


def _least(links: DataFrame) -> DataFrame:
    """u, its least v and its number n of links."""
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    """u > v -> every larger neighbour of a node to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(_least(both).select("u", F.least("u", "m").alias("m"), "n"), "links-least")
    # Only links to larger neighbours go on; their number is what may fill a task.
    found = join_unique(both.where("v > u"), least, ["u"], 2 * rows)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    """u > v -> a node and its smaller neighbours to the least of those."""
    least = staged(_least(e), "links-least")
    rest = join_unique(e, least, ["u"], rows).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 8).cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node each linked node reaches. Nodes without links are absent.

    links: pairs of longs, in any order, repeated or not; a pair with a null or of a node
    with itself links nothing. An empty table gives an empty table.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    e = staged(e, "links")
    mark = _mark(e)
    while mark[0]:
        # A large star has no more rows than the links before it.
        large = staged(_large_star(e, mark[0]), "links-large")
        e = staged(_small_star(large, mark[0]), "links")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
