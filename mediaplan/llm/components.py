"""Connected components over links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediaplan.sources.tables import keep


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest id.

    Alternates two joins until nothing changes: every id's larger neighbours are tied to its smallest
    neighbour, then its smaller ones. A hub's links shrink to stars, the rounds grow with the logarithm of
    the longest path, and no component is ever in one task: sums are partial before they move."""
    edges = keep(_oriented(links.filter("a <> b").select("a", "b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours and the id itself go to the least of the neighbourhood
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = _oriented(large.filter("a <> b").unionByName(
            least.filter("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")))).distinct()
        large = keep(large, "large-star")
        # small star: the smaller neighbours of an id go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
        small = small.unionByName(low.select(F.col("m").alias("a"), "b")).distinct()
        small = keep(small, "small-star")
        # stars only: every id has one smaller neighbour, which has none
        same = small.count() == edges.count() and small.exceptAll(edges).isEmpty()
        edges = small
        if same:
            return edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component").unionByName(
                edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
