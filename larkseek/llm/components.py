"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkseek.llm.common import scratch, stored

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type, a > b), where
    root is the smallest node reachable.

    Large-star: every node links its larger neighbours to the smallest node it sees. Small-star: it
    links its smaller neighbours, and itself, to the smallest. When a round changes nothing the edges
    are stars around the roots. Rounds grow with the logarithm of the longest path. Edges live in the
    shared folder; each join has one row per node on its other side, both sides plain shuffles, so
    the centre of a large star can be split by adaptive execution.
    """
    spark = edges.sparkSession
    current = stored(edges.select("a", "b").distinct(), scratch(spark, "edges"))
    before = _signature(current)
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), scratch(spark, "lowest"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, scratch(spark, "large"))
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("m")), scratch(spark, "lowest"))
        small = (large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lowest.withColumnRenamed("m", "b")).distinct())
        current = stored(small, scratch(spark, "edges"))
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return (current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
