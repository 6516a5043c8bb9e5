"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.frame import settle


def are_stars(links: DataFrame) -> bool:
    """Whether each node either has one link down or only links up."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")) \
        .unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.filter("down > 1 OR (down = 1 AND up = 1)").limit(1).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of the links (a, b): the least node reachable.

    Large-star and small-star steps alternate until the links are stars around the
    least node of each component. Both steps are a minimum per node and a join, so a
    node with very many links fills no task.
    """
    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while not are_stars(links):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = settle(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
    roots = links.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
