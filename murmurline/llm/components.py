"""Connected components of a table of links, by repeated least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, component (least node of its component) for every node of ``links`` (a, b).

    Alternates two contractions of the links: every node hands the neighbours above it to its least neighbour, then
    the neighbours below it. Links never grow in number, the rounds grow with the logarithm of the component's size, and
    the driver sees one number a round. Each round is a table of the shared folder.
    """
    links = cut_lineage(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links")
    state = None
    while True:
        links = cut_lineage(_small(_large(links)), "links")
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _large(links: DataFrame) -> DataFrame:
    """Neighbours above a node go to the least of the node and its neighbours."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Neighbours below a node, and the node, go to the least of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()
