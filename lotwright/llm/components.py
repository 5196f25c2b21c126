"""Connected components of a graph by alternating star contraction.

The large star step joins every neighbour above a node to the smallest node of its
neighbourhood, the small star step those below it. Both keep components as they
are and shorten paths, until every edge points at the smallest node of its
component. Minima are combined before the shuffle, and both sides of the joins are
plain shuffles of stored tables, so a node of very many edges is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Paths shorten by half a round or faster, so more rounds than this mean that something is wrong.
MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least node of u's neighbourhood, u included."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (u, v, m) for stored `edges`, m the least of u's neighbourhood; and the table of those."""
    least = common.store(_least(edges), "cc-least")
    return edges.join(least, "u"), least


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `links` (a, b); component is its least node."""
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.store(pairs, "cc-edge")
    before = None
    for _ in range(MOST_ROUNDS):
        both = common.store(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
        starred, least = _star(both)
        large = common.store(starred.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        common.discard(edges, both, least)
        starred, least = _star(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v")))
        edges = common.store(small.filter("u <> v").distinct(), "cc-edge")
        common.discard(large, least)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars
