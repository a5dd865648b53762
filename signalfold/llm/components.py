"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from signalfold.scale import work_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared work folder and read back: cuts the lineage and outlives lost executors."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of u (larger ones, or the smaller ones and u) are tied to the least."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        near = both.unionByName(turned)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        tied = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return tied.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of the links with the least node it is connected to.

    `links` has columns a, b.  A node's neighbours are only ever reduced to their minimum, which
    Spark does before the shuffle, so a node may have any number of links.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        told = Observation()
        facts = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        edges = stored(_star(_star(edges, True), False).observe(told, *facts), "edges")
        if told.get == seen:
            break
        seen = told.get
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
