"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.store import job, stored


def _stars(edges: DataFrame, smaller: bool) -> DataFrame:
    """One star step on edges (u, v): links each node's neighbours to the smallest of them.

    The large step links the larger neighbours, the small one the smaller ones
    and the node itself. Minima are combined before the shuffle, and the join
    back may be split where a node has very many neighbours.
    """
    both = edges if smaller else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if smaller:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node that it reaches) of every node with an edge.

    Alternates large and small star steps until nothing changes; each round is
    written to the shared folder, where only the result stays. Loops and repeated
    edges do no harm; no edges give no rows.
    """
    with job(edges.sparkSession, "components") as result:
        now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
        before = None
        while True:
            now = stored(_stars(_stars(now, False), True), "stars")
            state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if before == state:
                break
            before = state
        return result(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
