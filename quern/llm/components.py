"""Connected components of a link table, all in Spark: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stage


def _starred(edges: DataFrame) -> bool:
    """Whether each a has one b and no b is an a: then b is the smallest id of its component."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in links (a, b); component_id is the smallest id reachable.

    Each round joins every node with its smallest neighbour, so chains halve and stars
    stay stars; a node of very many links is a join key that adaptive execution splits.
    Links are written to the shared folder each round, never gathered on the driver.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _starred(edges):
        back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(back).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(back.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(edges.select("b", "b").distinct())


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (id, component_id), which hold every id of links, with the components joined that links (a, b) join: only those are walked again."""
    a, b = (parts.select(F.col("id").alias(x), F.col("component_id").alias(f"of_{x}")) for x in "ab")
    apart = links.join(a, "a").join(b, "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    whole = connected(apart).select(F.col("id").alias("component_id"), F.col("component_id").alias("whole"))
    return stage(parts.join(whole, "component_id", "left").select("id", F.coalesce("whole", "component_id").alias("component_id")), "components")
