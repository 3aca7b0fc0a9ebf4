"""Empty tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loreframe.session import cut_lineage


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node from links (a, b); the root is the smallest node reached.

    Alternating large-star and small-star rounds until nothing moves. Each round is two combinable
    minimum aggregates joined back on the node, so a hub with very many links is an ordinary skewed
    join; every round is checkpointed in the shared folder.
    """
    edges = links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u <> v").distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("__m"))
        low = low.select("u", F.least("u", "__m").alias("m"))
        # large star: every larger neighbour of u points to the smallest node around u
        edges = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u")
        edges = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = cut_lineage(edges)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if before == now:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
