"""Connected components of links, by stars that shrink towards the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.llm.tables import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for each end of a link ``a``, ``b``.

    Every node first links its larger neighbours, then its smaller ones, to the smallest
    of them; that takes a few rounds even for long chains. Minima are combined before
    they are shuffled, so a node with many links is no hot task.
    """
    edges = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        edges = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                        .distinct(), "large-star")
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        rest = edges.join(least, "a").where("b <> least").select(
            F.greatest("b", "least").alias("a"), F.least("b", "least").alias("b"))
        edges = written(rest.union(least).distinct(), "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
