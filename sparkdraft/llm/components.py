"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdraft.llm.store import stored


def _state(edges: DataFrame) -> tuple:
    # The hashes are cut to 32 bits so that their sum can't overflow.
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first())


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); the root is
    the smallest node of its component.

    Large-star links each node's larger neighbours to its smallest
    neighbour, small-star the others; repeated until every edge
    points at a root. Each round is two grouped minimums and two joins on the
    edge list and is written to the shared folder.
    """
    e = stored(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(spark, moved.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
