"""Connected components of a graph given as edges, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlake.llm.common import settle


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())


def _lowest(links: DataFrame) -> DataFrame:
    """The smallest neighbour of every node. Settled, so that the join with it can split a hot node."""
    return settle(links.groupBy("u").agg(F.min("v").alias("low")), "component-lows").withColumnRenamed("u", "node")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``u`` and ``v``, integers).

    The component is its smallest node. Large-star and small-star steps alternate: each links the
    neighbours of a node to its smallest neighbour, above the node or below it, until the edges
    are stars and no longer change. Every step is written to the shared folder, so a lost executor costs no more
    than that step. The number of rounds follows the logarithm of the longest path. Nulls and
    loops link nothing. An empty table gives no rows.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = settle(links, "component-links")
    before, now = None, _mark(links)
    while now != before:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        large = both.where("v > u").join(low, F.col("u") == F.col("node")).select(
            F.col("v").alias("u"), F.least("low", "node").alias("v")).distinct()
        large = settle(large, "component-links")
        low = _lowest(large)
        moved = large.join(low, F.col("u") == F.col("node")).where("v <> low").select(
            F.col("v").alias("u"), F.col("low").alias("v"))
        links = settle(moved.unionByName(low.select(F.col("node").alias("u"), F.col("low").alias("v"))).distinct(), "component-links")
        before, now = now, _mark(links)
    centres = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        centres.select("node", F.col("node").alias("component")))
