"""Connected components of an undirected graph by alternating large-star and
small-star steps: each step joins edges with the smallest neighbour of a node,
so the number of rounds grows with the logarithm of a component's size and no
step gathers a component or a neighbourhood in one place.

Every round is checkpointed into the shared folder, which cuts the lineage; the
minima are checkpointed too, so that both sides of the join are plain shuffles
and a node with very many edges can be split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.session import ensure_checkpoint_dir


def _mark(e: DataFrame) -> tuple:
    """Order-free fingerprint of a set of edges."""
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _star(pairs: DataFrame) -> DataFrame:
    """(x, y) -> (x, y, m): m the smallest of x and its y."""
    low = pairs.groupBy("x").agg(F.min(F.least("x", "y")).alias("m")).checkpoint()
    return pairs.join(low, "x")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its
    smallest node.  Self-links and repeated links are allowed; links with a
    null end are ignored."""
    ensure_checkpoint_dir(edges.sparkSession)
    lone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("component"))
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint())
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        large = _star(both).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct().checkpoint()
        small = _star(large)
        e = (small.where("y != m").select(F.col("y").alias("u"), F.col("m").alias("v"))
             .unionByName(small.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct().checkpoint())
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
            .unionByName(lone).groupBy("node").agg(F.min("component").alias("component")))
