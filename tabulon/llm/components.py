"""Connected components of a graph of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import KEY_ROWS, spread_join
from .common import forget, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, component: the smallest node reachable, for each node in a link.

    Large-star and small-star rounds in turn: each points nodes at the smallest
    neighbour they know, until no link changes. A node's links fan in through
    partial aggregates, and each round is a table of its own, so a lost executor
    costs one round. Rounds go on until nothing changes; their number grows with
    the logarithm of the nodes. Null ends and self-links are ignored."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(pairs, "links")
    while True:
        # while links are few no node has too many of them
        join = spread_join if now.count() > KEY_ROWS else DataFrame.join
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large-star: neighbours above a node point at the smallest node that it knows
        large = join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: a node's smaller neighbours, and itself, point at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join(large, low, ["a"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = written(small, "links")
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        forget(now)
        now = after
        if same:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
