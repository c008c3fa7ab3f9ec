"""Connected components of a table of edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TIMES, cut, discard, skewed

#: Edges up to which one task may hold all of those of a node.
PLAIN = 1 << 18


def stars(edges: DataFrame) -> bool:
    """Whether every u has one edge, to a node that is no u: then each component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out > 0 AND in > 0)").isEmpty()


def with_least(edges: DataFrame, most: int, done: list[DataFrame]) -> DataFrame:
    """edges (most at most) with m, the smallest v of u. Tables that are written for it go into done."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias(TIMES))
    if most <= PLAIN:
        return edges.join(least.drop(TIMES), "u")
    done.append(cut(least, "least"))
    return skewed(edges, done[-1], ["u"], most)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node with an edge other than the root itself.

    Alternates two steps until all components are stars: every node's larger neighbours are linked to its smallest one,
    then every node's smaller neighbours and the node itself are. Both keep components and shorten paths; the edges of each
    round are written to the shared folder. Nodes with a large share of many edges (hubs) are joined by broadcast.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not stars(e):
        most, done = 2 * e.count(), [e]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, most, done).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        if most > PLAIN:
            large = cut(large, "large")
            done.append(large)
        small = with_least(large, most, done)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, "edges")
        discard(spark, *done)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.kinfold_path = e.kinfold_path
    return out
