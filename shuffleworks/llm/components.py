"""Connected components by large-star and small-star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shuffleworks.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Tie the larger (or smaller) neighbours of each node to the least of its neighbours and itself.

    The least ones are written first: both sides of the join are then plain
    shuffles, of which Spark can split the partition of a node with many edges.
    """
    if not larger:
        pairs = pairs.where("v < u")
    least = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    tied = pairs.join(least, "u")
    if larger:
        found = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return found.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of ``edges`` (u, v: long).

    Every round is written to the shared folder; it ends when a round changes
    nothing, after about the logarithm of the longest path.
    """
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")]
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        edges = cut(_star(_star(_both_ways(edges), larger=True), larger=False), "edges")
        now = edges.agg(*mark).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
